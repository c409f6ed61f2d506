"""keysift: a Spark-native audit for leaked credentials in files, documents and version-control patch logs."""
