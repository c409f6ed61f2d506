"""Pseudonyms against a plain Feistel network; decontamination against plain Python."""

from __future__ import annotations

import hashlib
import hmac
import random
import re
from datetime import date, timedelta

import numpy as np
import pytest

from keysift.llm import decontaminate as leaks
from keysift.llm.fm_index import FmIndex
from keysift.llm.pii import DAYS, ROUNDS, pseudonymise


def feistel(symbols, radices, tweak, key):
    half = (len(symbols) + 1) // 2
    a, b, ra, rb = symbols[:half], symbols[half:], radices[:half], radices[half:]

    def stream(number, other, i, radix):
        told = "|".join([tweak, str(len(symbols)), str(number), str(i), ",".join(map(str, other))])
        return int(hmac.digest(key.encode(), told.encode(), "sha256").hex()[:13], 16) % radix

    for number in range(ROUNDS):
        if number % 2 == 0:
            a = [(v + stream(number, b, i, r)) % r for i, (v, r) in enumerate(zip(a, ra))]
        else:
            b = [(v + stream(number, a, i, r)) % r for i, (v, r) in enumerate(zip(b, rb))]
    return a + b


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def plain_card(number, key):
    body = feistel([int(c) for c in number[:-1]], [10] * (len(number) - 1), "card", key)
    return "".join(map(str, body)) + str((10 - luhn(body + [0])) % 10)


def plain_phone(digits, key):
    moved = feistel([int(d) - (2 if i in (0, 3) else 0) for i, d in enumerate(digits)], [8, 10, 10, 8] + [10] * 6, "phone", key)
    return "".join(str(d + (2 if i in (0, 3) else 0)) for i, d in enumerate(moved))


def masked(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pseudonymise(docs, key).collect()}


def test_values(spark):
    key, card, phone = "some key", "4111111111111111", "9885552485"
    local, mail = "Joe.X-42_b", "@mail8.example.com"
    name = feistel([9, 14, 4, 0, 23, 0, 4, 2, 0, 1], [26, 26, 26, 1, 26, 1, 10, 10, 1, 26], "email", key)
    signs = "".join(
        c if not c.isalnum() else chr(n + ord("0" if c.isdigit() else "A" if c.isupper() else "a")) for c, n in zip(local, name)
    )
    day = (date(2024, 2, 29) - date(1900, 1, 1)).days
    high, low = feistel([day // DAYS[1], day % DAYS[1]], list(DAYS), "date", key)
    new_day = date(1900, 1, 1) + timedelta(days=high * DAYS[1] + low)
    area, group, serial = feistel([123 - 1, 44, 6788], [898, 99, 9999], "ssn", key)
    area = area + 1 + (area + 1 >= 666)
    new_card, new_phone = plain_card(card, key), plain_phone(phone, key)
    octets = ".".join(map(str, feistel([42, 144, 35, 254], [256] * 4, "ip", key)))
    pairs = [
        (card, new_card),
        ("4111 1111 1111 1111", " ".join(new_card[i : i + 4] for i in range(0, 16, 4))),
        ("+1 (988) 555-2485", f"+1 ({new_phone[:3]}) {new_phone[3:6]}-{new_phone[6:]}"),
        ("988.555.2485", f"{new_phone[:3]}.{new_phone[3:6]}.{new_phone[6:]}"),
        ("42.144.35.254", octets),
        (local + mail, signs + mail),
        ("2024-02-29", new_day.isoformat()),
        ("29.02.2024", new_day.strftime("%d.%m.%Y")),
        ("123-45-6789", f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"),
    ]
    found = masked(spark, [f"{old}, and ({old}) and {old}." for old, _ in pairs] + [" ".join(old for old, _ in pairs)], key)
    for i, (_, new) in enumerate(pairs):
        assert found[i]["text"] == f"{new}, and ({new}) and {new}."
    assert found[len(pairs)]["text"] == " ".join(new for _, new in pairs)


def test_left_alone(spark):
    texts = ["4111111111111112", "2023-02-29", "000-12-3456", "1850-01-01", "188.555.2485", "1.2.3.256", "a@b", "123456",
             "x4111111111111111", "42.144.35.254.1", None, "", "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f54111\""]
    found = masked(spark, texts)
    assert [found[i]["text"] for i in range(len(texts))] == texts and all(not r["found"] for r in found.values())


def test_shapes(spark):
    """Any leading digit, cards of 4-6-5 digits, and days from 2099-11-13 on."""
    key, phones = "k", ["0175557713", "1321551352", "9880552485", "1880552485"]

    def plain(digits):
        base = [(2, 0) if d < "2" else (8, 2) for d in (digits[0], digits[3])]
        radices, least = [10] * 10, [0] * 10
        for i, (radix, low) in zip((0, 3), base):
            radices[i], least[i] = radix, low
        moved = feistel([int(d) - low for d, low in zip(digits, least)], radices, "phone", key)
        return "".join(str(d + low) for d, low in zip(moved, least))

    pairs = []
    for old in phones:
        for shape in ("+1 ({}) {}-{}", "({}) {}.{}", "+1.{}.{}.{}", "{}-{}-{}", "{} {} {}"):
            pairs.append(tuple(shape.format(d[:3], d[3:6], d[6:]) for d in (old, plain(old))))
    card = plain_card("378282246310005", key)
    pairs += [(f"3782{c}822463{c}10005", f"{card[:4]}{c}{card[4:10]}{c}{card[10:]}") for c in " -"]
    first, radices = date(2099, 11, 13), [2344, 1231]
    assert (date.max - first).days + 1 == radices[0] * radices[1]
    for old in (first, date(2150, 3, 1), date.max):
        high, low = feistel(list(divmod((old - first).days, radices[1])), radices, "date", key)
        new = first + timedelta(days=high * radices[1] + low)
        pairs += [(old.isoformat(), new.isoformat()), (f"{old:%d.%m.%Y}", f"{new:%d.%m.%Y}")]
    found = masked(spark, [f"{old}, and ({old}) and {old}." for old, _ in pairs], key)
    for i, (_, new) in enumerate(pairs):
        assert found[i]["text"] == f"{new}, and ({new}) and {new}." and len(found[i]["found"]) == 3


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_phone_of_documents_stays(spark, scale):
    shape = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9A-Za-z])")
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").filter("text LIKE '%+1 (%'")
    old, new = ({r["doc_id"]: shape.findall(r["text"]) for r in rows.collect()} for rows in (docs, pseudonymise(docs, "corpus-2024")))
    pairs = [pair for key in old for pair in zip(old[key], new[key], strict=True)]
    assert len(pairs) > 5 and all(a != b for a, b in pairs)
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(pairs))


def test_key_is_not_told(spark, capsys):
    """Neither the key nor what HMAC makes of it stands in a plan; a key longer than a block counts whole."""
    docs = spark.createDataFrame([(1, "call +1 (988) 555-2485", "x")], "doc_id long, text string, Pads string")
    for key in ("corpus-2024", "k" * 100):
        rows = pseudonymise(docs, key)
        rows.explain(True), rows.explain("formatted")
        plan = capsys.readouterr().out + rows._jdf.queryExecution().toString()
        block = (hashlib.sha256(key.encode()).digest() if len(key) > 64 else key.encode()).ljust(64, b"\0")
        for secret in (key.encode(), *(bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))):
            assert all(told not in plan.lower() for told in (repr(secret)[2:-1].lower(), secret.hex()[:16], str(list(secret))[1:20]))
        moved = plain_phone("9885552485", key)
        row = rows.first()
        assert rows.columns == ["doc_id", "text", "Pads", "found"] and row["Pads"] == "x"
        assert row["text"] == f"call +1 ({moved[:3]}) {moved[3:6]}-{moved[6:]}"


def test_permutation(spark):
    """All values of a small format are taken once each."""
    texts = [f"{a}@x.org" for a in ["%02d" % i for i in range(100)]]
    found = masked(spark, texts)
    assert sorted(r["text"] for r in found.values()) == texts


def test_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "x " * 500_000 + "988-555-2485", 1, 2)], "doc_id long, text string, found int, `a.b` int")
    made = pseudonymise(docs, "k")
    row = made.first()
    assert set(made.columns) == {"doc_id", "text", "found", "a.b"} and len(row["text"]) == 1_000_012
    assert "988-555-2485" not in row["text"] and pseudonymise(docs.limit(0), "k").count() == 0
    assert pseudonymise(docs.filter("false"), "k").columns == made.columns


def test_hostile_lines(spark):
    texts = ["a" * 300_000 + "@", "1" * 300_000, "a.b@" + "c." * 50_000, "1-" * 100_000, "@" * 100_000]
    assert [r["text"] for r in sorted(masked(spark, texts).values())] == texts


def test_fm_index():
    draw = np.random.default_rng(3)
    for size, letters in ((1, 1), (10, 2), (300, 3), (500, 60)):
        text = draw.integers(0, letters + 1, size)
        index = FmIndex(text, letters + 1, sample=4)
        for length in (1, 2, 5):
            phrases = draw.integers(0, letters + 1, (40, length))
            low, high = index.search(phrases)
            for phrase, a, b in zip(phrases, low, high):
                want = [i for i in range(size - length + 1) if (text[i : i + length] == phrase).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans_of(text):
    return [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(docs, items, width):
    windows = {}
    for name, text in items:
        words = [text.lower()[a:b] for a, b in spans_of(text)] if text else []
        for i in range(max(1, len(words) - width + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + width]), set()).add(str(name) if name is not None else "null")
    out = {}
    for key, text in docs:
        places = spans_of(text)
        words = [(text or "")[a:b].lower() for a, b in places]
        hit, names = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if held := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= held
        runs = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
        cut, at = "", 0
        for a, b in zip(*runs):
            cut += text[at : places[a][0]]
            at = places[b - 1][1]
        out[key] = (len(words), len(hit), sorted(names), list(zip(*runs)), None if text is None else cut + text[at:])
    return out


@pytest.mark.parametrize("block_bytes,shard_bytes", [(16 << 20, 8 << 20), (120, 200)])
def test_decontaminate(spark, monkeypatch, block_bytes, shard_bytes):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(leaks, "SHARD_BYTES", shard_bytes)
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "ß", "A1"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 2, 3, 6, 9])))) for i in range(25)]
    items += [(None, "w1, w2 W3!"), (3, "other words here w1"), (99, None), (100, "  ")]
    docs = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(draw.randint(0, 40)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " ".join(f"x{i} " + items[0][1] for i in range(3000)))]
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 4)
    for clean in (False, True):
        rows = leaks.decontaminate(frame, bench, width=4, cleaned=clean).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], [(s["first"], s["last"]) for s in r["spans"]]) for r in rows}
        assert got == {k: v[:4] for k, v in want.items()}
        if clean:
            assert {r["doc_id"]: r["text"] for r in rows} == {k: v[4] for k, v in want.items()}


def test_repeated_items(spark, monkeypatch):
    """Repeated rows of an item, more than a block holds, are searched once."""
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 30)
    bench = spark.createDataFrame([(7, "some words of an item")] * 20 + [(8, "and others")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are some words of an item, and others")], "doc_id long, text string")
    counts, blocks = [], leaks._blocks

    def checked(items):
        rows = items.collect()
        assert len(rows) == len(set(rows)) == 2
        counts.append(len(rows))
        return blocks(items)

    monkeypatch.setattr(leaks, "_blocks", checked)
    row = leaks.decontaminate(docs, bench, width=3).first()
    assert counts == [2] and (row["n_hit"], row["items"]) == (7, ["7", "8"])


def test_decontaminate_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "A, B")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in leaks.decontaminate(docs, bench).collect()) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert {r["n_hit"] for r in leaks.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert leaks.decontaminate(docs.limit(0), bench).count() == 0
