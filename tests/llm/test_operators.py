"""Each text operator against a brute-force version, on a fixture of odd rows and on small tables."""

import base64
import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spikeloom.llm import common, decontaminate, fingerprint, graph, license_scan, packing, quality, queries, resemblance, simhash, token_count, token_store, tokenize, url_filter, warc
from spikeloom.llm.tokenize import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(6_000))
ODD = [
    (None, "null id text with a few words here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (6, "a  b   c \n d\r\n e\x0b f "),
    (7, "É é Ünïcödé ΑΣ ΑΣ. İ 漢字かな é \U0001f600 x"), (8, "<|endoftext|> it's 'S don't <0x0A> ▁ ▁▁"), (9, "x" * 5000), (10, "same text of five words"), (11, "same text of five words"), (12, "A | B || C |"),
]
SCHEMA = "doc_id long, text string, fingerprint string, n_words string, id int, class int, component_id int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2, 3) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(ascii_lower(t or ""))


@functools.cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def whole(path, text, end):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(docs):
    texts = [t or "" for _, t in ODD] + [r.text for r in docs.limit(40).collect()]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        enc = Encoder(queries.tokenizer_path(name), kind)
        for _ in range(2):
            for t, ids in zip(texts, enc.ids(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@pytest.mark.parametrize("direct", [True, False])
def test_encoder_on_marks_and_letters(name, kind, direct):
    """Letters with closing marks, and what only looks like them, by both ways."""
    texts = [
        "", " ", "a", "İx. ǅenan! ŉ'S ſt. ß", "it's 's'tart dogs' é. É— é—. ǃKung…", "x" + "=" * 3000, "Ω.Σ. ΑΣ. a̸ ≮", "|" * 50 + " a| |b",
        "\n", "\n\n", "a\n\n", "\n\na", "a\n\n\nb", "a\n\nb\n", "a \nb", "a\n b", "a\n \nb", "\n\u00a0\u00a0x", "a\t\nb", " a", "a ", "a  b", "x\u2028\ny",
        "naïve|x y|", "A" * 5000 + "!" * 5000 + " b", "<|endoftext|> x", "a\tb\r\nc\n\nd", "ª.º.µ. aª b·. ·", "ÿ.Ÿ! Ā# ɏ. ɐ.", "a\x1c.b \x85. c\xa0.",
    ]
    enc = Encoder(queries.tokenizer_path(name), kind)
    assert enc.direct
    enc.direct = direct
    enc.cores.size, enc.tails.size = 3, 2  # generations change within a batch
    for _ in range(2):
        for t, got in zip(texts, enc.ids(texts), strict=True):
            assert got == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def test_encoder_in_slices_and_parts(monkeypatch, docs):
    texts = [t for _, t in ODD] + [r.text for r in docs.limit(20).collect()]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        enc = Encoder(queries.tokenizer_path(name), kind)
        ids, ends = enc.encode(pa.array(texts), 9)
        assert ids.tolist() == [x for t in texts for x in [*enc.tok.encode(t or "", add_special_tokens=False).ids, 9]] and ends[-1] == len(ids)
        monkeypatch.setattr(tokenize, "LONG_CHARS", 50)
        monkeypatch.setattr(tokenize, "PART_BYTES", 300)
        again, stops = enc.encode(pa.array(texts, pa.large_string()), 9)
        assert (again == ids).all() and (stops == ends).all()
        monkeypatch.undo()
        assert len(enc.encode(pa.array([], pa.string()), 9)[0]) == 0 and enc.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_token_counts(spark, odd, docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_count.Vocabulary.from_sentencepiece(queries.tokenizer_path("piece_bpe_32k.model"))
    lib = Tokenizer(models.Unigram(list(zip(vocab.pieces, vocab.scores, strict=True)), vocab.unk_id, True))
    gaps = spark.createDataFrame([(i, t) for i, t in enumerate(["a  b", "   a", "a    b  c ", " ", "  ", " a", "a ", "a \n b\n\nc\n", "\n", "é\n  \n日本 \x00", "▁▁ a", "x" * 300])], "doc_id long, text string")
    for split in (False, True):
        lib.pre_tokenizer = pre_tokenizers.Metaspace(split=split)
        for df in (odd, gaps, docs.limit(60)):
            text = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
            got = sorted((str(r.doc_id), r.n_tokens) for r in token_count.count_tokens(df, vocab, split=split).collect())
            assert got == sorted((str(i), len(lib.encode(t or "").ids)) for i, t in text)
    assert token_count.count_tokens(empty, vocab).count() == 0


@pytest.mark.parametrize("crossing", [(), ("▁a▁b", "a▁"), ("a\nb", "▁▁")])
@pytest.mark.parametrize("byte", [False, True])
def test_token_counts_follow_ties(crossing, byte, monkeypatch):
    """Small vocabularies with many equal scores, also with pieces that cross spaces, by the library and by all paths."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = ("<unk>", "a", "b", "ab", "ba", "▁", "▁a", *crossing, *([f"<0x{b:02X}>" for b in range(256)] if byte else []))
    small = token_count.Vocabulary(pieces, tuple(0.0 if p == "<unk>" else -10.0 if p[0] == "<" else -1.0 * min(len(p), 2) for p in pieces))
    lib = Tokenizer(models.Unigram(list(zip(small.pieces, small.scores, strict=True)), 0, byte))
    rng = random.Random(1)
    for split in (False, True):
        lib.pre_tokenizer = pre_tokenizers.Metaspace(split=split)
        for stride in (1 << 16, 3):
            monkeypatch.setattr(token_count, "STRIDE", stride)
            counter = token_count.UnigramCounter(small, split)
            texts = ["".join(rng.choice("ab cé\n") for _ in range(rng.randrange(14))) for _ in range(300)]
            n, s = counter.count(pa.array(texts))
            for i, t in enumerate(texts):
                assert n[i] == len(lib.encode(t).ids), t
                marked = "▁" + t.replace(" ", "▁").removeprefix("▁") if t else ""
                if not split:
                    top = [0.0]
                    for j in range(1, len(marked) + 1):
                        ends = [top[j - len(p)] + x for p, x in zip(small.pieces, small.scores, strict=True) if marked[:j].endswith(p) and len(p) <= j]
                        top.append(max([*ends, top[j - 1] + counter.unk]))
                    assert abs(s[i] - top[-1]) < 1e-9


def brute_hits(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for ident, t in items:
        iw = words(t)
        n = min(len(iw), window)
        if ident is None or not n:
            continue
        have = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in have:
                hit.update(range(i, i + n))
                found.add(str(ident))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [400_000, 60])
def test_contamination(spark, odd, docs, empty, block):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25)))) for i in range(12)] + [(None, "x y"), (90, "two words"), (91, None), (3, "A b C d")]
    made = [(100 + i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [(i, t) for i, t in ODD if i != 5]
    df = spark.createDataFrame([(i, t, "clash") for i, t in made], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench, block_words=block).select("doc_id", "n_words", decontaminate.hit_words().alias("h"), "items").collect()
    assert sorted((str(r.doc_id), r.n_words, r.h, r["items"]) for r in got) == sorted((str(i), *brute_hits(t, items)) for i, t in made)
    assert decontaminate.contamination(empty, bench, block_words=block).count() == 0
    none = decontaminate.contamination(df, bench.limit(0), block_words=block)
    assert none.filter(F.size("items") > 0).count() == 0 and none.count() == len(made)


@pytest.mark.parametrize("block", [400_000, 20])
def test_items_without_id(spark, block):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, item), (None, "two words"), (4, "e f g")], "item_id long, text string")
    df = spark.createDataFrame([(1, "a " + item + " b"), (2, "e f g two words"), (3, "none of them")], "doc_id long, text string")
    got = {r.doc_id: (r.h, r["items"]) for r in decontaminate.contamination(df, bench, block_words=block).select("doc_id", decontaminate.hit_words().alias("h"), "items").collect()}
    assert got == {1: (20, []), 2: (5, ["4"]), 3: (0, [])}
    assert {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()} == {3}


@pytest.mark.parametrize("block", [400_000, 30])
@pytest.mark.parametrize("cut", [False, True])
def test_remove_contaminated_from_odd_rows(spark, odd, empty, block, cut):
    """Null, empty, repeated and wordless texts stay; columns with clashing names pass; hit words can be cut out."""
    item = " ".join(f"i{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "x9 y9 z9"), (5, " ".join(f"j{k}" for k in range(40)))], "item_id long, text string")
    names = "doc_id long, text string, row string, starts string, ends string, doc string, items string, __kept string"
    rows = [(i, t) for i, t in ODD] + [(50, f"Before {item.upper()}, after."), (51, "x9, y9! z9"), (52, "x9 y9"), (None, f"a {item}"), (53, "w " * 90 + "x9 y9 z9")]
    df = spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], names)
    left = decontaminate.remove_contaminated(df, bench, cut_spans=cut, block_words=block)
    assert left.columns == df.columns
    clean = [(i, t) for i, t in rows if i in (52, 53) or (i, t) in ODD]
    want = clean + ([(50, "Before , after."), (51, ""), (None, "a ")] if cut else [])
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in left.collect()) == sorted((str(i), str(t), *"abcdef") for i, t in want)
    assert decontaminate.remove_contaminated(empty, bench, cut_spans=cut, block_words=block).count() == 0


def test_remove_contaminated(spark, docs):
    bench = common.table(spark, SF, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    bad = {i for i, t in rows.items() for n, h, _ in [brute_hits(t, items)] if h and 20 * h >= n}
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and bad and {r.doc_id for r in left.collect()} == rows.keys() - bad
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, bench, cut_spans=True).collect()}
    assert cut.keys() == rows.keys() and all((cut[i] == rows[i]) == (i not in bad) for i in rows)


def test_token_store(spark, odd, docs, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    for df in (odd, docs):
        at = common.fresh_path(spark, "t")
        token_store.write_store(df, at, path, "byte", 0, width=2)
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), whole(path, r.text, 0)) for r in df.select("doc_id", "text").collect())
        want, start = [], 0
        for (known, i), ids in rows:
            want.append((i if known else None, start, len(ids), crc(ids)))
            start += len(ids)
        got = sorted(token_store.read_store(spark, at, 2).collect(), key=lambda r: r.start)
        assert [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
        back = {r.start: r.ids for r in token_store.read_ids(spark, at, 2).collect()}
        assert [back[w[1]] for w in want] == [r[1] for r in rows]
        digests = [bytes(r.digest) for r in token_store.chunks(spark, at).collect()]
        assert len(digests) == len(set(digests))
    at = common.fresh_path(spark, "t")
    token_store.write_store(empty, at, path, "byte", 0)
    assert token_store.read_store(spark, at).count() == 0


def test_token_store_without_end_id(spark):
    path, at = queries.tokenizer_path("byte_bpe_50k.json"), common.fresh_path(spark, "t")
    rows = [(5, ""), (None, None), (1, "a b"), (5, ""), (3, None), (5, "c d e")]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), at, path, "byte")
    want = sorted((i is not None, i or 0, library(path).encode(t or "").ids) for i, t in rows)
    got = sorted(token_store.read_store(spark, at).collect(), key=lambda r: (r.start, r.id is not None, r.id or 0, r.n_tokens))
    assert sorted((r.id is not None, r.id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((k, i, len(x), crc(x)) for k, i, x in want)
    assert [r.start for r in got] == sorted(np.cumsum([0, *[len(x) for *_, x in want]])[:-1].tolist())
    assert sorted(r["ids"] for r in token_store.read_ids(spark, at).collect()) == sorted(x for *_, x in want)


def test_recipes_ascend_over_files(spark):
    """Also with one id on half of the rows, whose recipes are dealt over several files."""
    at = common.fresh_path(spark, "t")
    rows = [(i if i % 2 else 41, f"text {i}") for i in range(400)] + [(None, "none")]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), at, queries.tokenizer_path("byte_bpe_50k.json"), "byte", 0)
    found = token_store.recipes(spark, at).collect()
    ordered = sorted(found, key=lambda r: (r.block, r.start))
    assert [r.start for r in ordered] == sorted(r.start for r in found) and len(found) == len(rows)
    ids = [(r.id is not None, r.id or 0) for r in ordered]
    assert ids == sorted(ids) and len({r.block for r in found if r.id == 41}) > 1
    sizes = [r.n_tokens for r in ordered]
    assert [r.start for r in ordered] == np.cumsum([0, *sizes])[:-1].tolist()


def test_store_shows_tampering(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, f"text {i} with some words") for i in range(30)], "doc_id long, text string")

    def changed(part, change):
        at = common.fresh_path(spark, "t")
        token_store.write_store(df, at, path, "byte", 0)
        where = f"{at}/{part}"
        old = spark.read.parquet(where)
        rows = old.collect()
        new = spark.createDataFrame(change([r.asDict() for r in rows]), old.schema)
        writer = new.coalesce(1).write.mode("overwrite")
        (writer.partitionBy("block") if part == "recipes" else writer).parquet(where)
        return at

    def first(**new):
        return lambda rows: [{**rows[0], **new}, *rows[1:]]

    for part, change in (
        ("chunks/kind=chunk", first(data=b"\0\0\0\0" * 6)), ("chunks/kind=chunk", lambda rows: rows[1:]), ("recipes", first(digests=b"x" * 16)), ("recipes", first(n_tokens=1)),
        ("recipes", lambda rows: rows[1:]), ("recipes", first(root=b"x" * 16)), ("manifests", first(root=b"x" * 16)), ("manifests", lambda rows: rows[1:]), ("manifests", first(tokens=1)),
    ):
        at = changed(part, change)
        for read in (token_store.read_store, token_store.read_ids):
            with pytest.raises(Exception, match="don't match|doesn't match|can't be rebuilt"):
                read(spark, at).collect()
    with pytest.raises(Exception, match="two bytes"):
        token_store.write_store(df, common.fresh_path(spark, "t"), path, "byte", 70_000, width=2)


def test_crc_joins():
    rng = random.Random(3)
    parts = [[rng.randbytes(rng.randrange(0, 700)) for _ in range(rng.randrange(0, 6))] for _ in range(60)] + [[b"", b"x" * 100_000, b""]]
    flat = [p for ps in parts for p in ps]
    got = token_store.crc_joins(np.array([zlib.crc32(p) for p in flat]), np.array([len(p) for p in flat]), np.array([len(ps) for ps in parts]))
    assert got.tolist() == [zlib.crc32(b"".join(ps)) for ps in parts]
    assert token_store.crc_joins(np.zeros(0), np.zeros(0), np.zeros(0, np.int64)).tolist() == []


def test_license_scan(spark, odd, empty):
    texts = [
        (1, "x\nLicensed under the Apache License, Version 2.0.\nMIT license mit license"), (2, "cc by cc by\nGNU General\nPublic License"), (3, None), (4, "licensed under cc by-nc 4.0"),
        (5, "license apache the under licensed 2 version"), (6, "licensed under the apache"), (7, "")]
    df = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, blocks string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in texts:
        w = words(t)
        places = sorted((p, label) for ph, label in license_scan.PHRASES for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split())
        assert [(x.word, x.label) for x in got[i].base_places] == places and got[i].n_words == len(w)
        want = []
        for n, line in enumerate((t or "").split("\n")):
            have = set(words(line))
            for k, (template, label) in enumerate(license_scan.TEMPLATES):
                whole_t = set(template.split())
                if len(have & whole_t) >= 0.8 * len(whole_t) - 1e-9:
                    want.append((n, k, label, len(have & whole_t) / len(whole_t)))
        assert [(x.line, x.template, x.label, x.containment) for x in got[i].blocks] == want
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(empty).count() == 0


def test_license_scan_over_lines(spark):
    mit, bsd, mpl = (license_scan.TEMPLATES[k][0].split() for k in (3, 8, 9))
    wrap = lambda w, n: "\n * ".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [
        (1, "x y\n" + wrap(mit, 13)), (2, wrap(bsd, 6) + "\nz"), (3, wrap(mpl, 12)), (4, "\n".join(mpl)), (5, wrap(mit[:10], 5)), (6, "\n".join(f"{w} a b c d" for w in bsd)),
        (7, " ".join(mit[:-1]) + "\n" + mit[-1] + "\n" + wrap(bsd, 4) + "\n\n" + wrap(bsd, 5))]
    got = {r.doc_id: [(x.line, x.label, x.containment) for x in r.blocks] for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    bits = len(set(mit))
    assert got == {1: [(1, "mit", 1.0)], 2: [(0, "bsd", 1.0)], 3: [(0, "mpl", 1.0)], 4: [(0, "mpl", 1.0)], 5: [], 6: [], 7: [(0, "mit", (bits - 1) / bits), (0, "mit", 1.0), (2, "bsd", 1.0), (9, "bsd", 1.0)]}


def test_license_scan_finds_whole_notices(spark):
    """A notice in a comment block over many lines, a few of its words left out or changed, gives its template."""
    import textwrap

    rng, rows, want = random.Random(11), [], {}
    for k, (text, label) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        if len(w) < 25:
            continue
        w = [x if rng.random() > 0.05 else "changed" for x in w]
        body = "\n".join(f" * {line}" for line in textwrap.wrap(" ".join(w).capitalize() + ".", 60))
        rows.append((k, f"/*\n * Copyright 2020\n{body}\n */\nint main() {{ return 0; }}"))
        whole_t = set(text.split())
        want[k] = (label, len(whole_t & {x for x in w}) / len(whole_t))
    got = {r.doc_id: r.blocks for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, share) in want.items():
        best = max(b.containment for b in got[k] if b.template == k)
        assert share >= 0.8 and best >= share - 0.05 and label in {b.label for b in got[k]}


def test_warc(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\n", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 300_000), (7, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "lone"), (None, "u", "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    for least in (0, 5):
        files = warc.write_archives(warc.plan(df, min_bytes=least), chunk=1000)
        got = sorted((str(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.read_records(files).collect())
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            best = max((j for j, _, o in rows if (o or "") == (h or "") and j is not None), default=None)
            again = len(raw) >= least and best is not None and best != i
            want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", str(best) if again else "None"))
        assert got == sorted(want)
        parts = warc.read_chunks(files, chunk=1000).collect()
        for r in rows:
            own = sorted((p for p in parts if p.record_id == (None if r[0] is None else str(r[0])) and p.record_type == "response"), key=lambda p: p.chunk_no)
            if r[0] == 6:
                assert b"".join(bytes(p.chunk) for p in own) == r[2].encode() and max(len(p.chunk) for p in own) <= 1000 and bytes(own[-1].sha1_so_far) == hashlib.sha1(r[2].encode()).digest()
    none = warc.write_archives(warc.plan(df.limit(0)))
    assert warc.read_records(none).count() == 0


def test_packing(spark, odd, docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    for df in (odd, docs):
        placed, stored = packing.pack(df, path, "word", 1)
        rows = placed.collect()
        ids = {(r.id, r.start): np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in stored.collect()}
        assert all(crc(ids[r.id, r.start]) == r.ids_crc32 and len(ids[r.id, r.start]) == r.length for r in rows)
        texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        copies = {i: sum(j == i for j, _ in texts) for i, _ in texts}
        for i, t in texts:
            own = sorted((r for r in rows if r.id == i), key=lambda r: r.start)[:: copies[i]]
            assert list(itertools.chain.from_iterable(ids[i, r.start] for r in own)) == whole(path, t, 1) and {r.doc_tokens for r in own} == {len(whole(path, t, 1))}
        total, padded = sum(r.length for r in rows), 0
        for _, seq in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
            at = 0
            for r in seq:
                assert r.offset == at
                at += r.length
            assert at <= 2048
            padded += 0 if at & (at - 1) == 0 else 2048 - at
        assert len({r.sequence_id for r in rows}) == max(r.sequence_id for r in rows) + 1
        assert padded <= 0.04 * total + 4096
    assert packing.pack(empty, path, "word", 1)[0].count() == 0


def test_cut_rest():
    for n in range(1, 2048):
        cut = packing.cut_rest(n)
        assert sum(x for x, _ in cut) == n and all(0 < x <= 2048 // k and x > 2048 // (k + 1) - 1 for x, k in cut)


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "http://NET", "http://a.net/", "https://a.net?x=/", "http://example.net/en/x", "http://www.Example.NET/en/", "http://example.net/de/", "http://notexample.com/de/",
        "http://example.com/de/1#x", "ftp://b.org/fr/://", "http://org/fr/", "http://x.org/FR/", "http://.net/", "://net/", "http://" + "a." * 500 + "net/" + "p/" * 500, "http://example.net/en/x"]
    df = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)], "page_id long, url string, host string, digest string")
    rules = [*url_filter.RULES, ("allow", "a.net", "/"), ("block", "com", ""), ("block", "org", "/fr/")]
    got = {r.page_id: tuple(r) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, rules)).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h) + len(p), len(h), a == "allow", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        assert got[i] == (i, host, path, best[3], best[4]), u
    assert url_filter.filter_urls(df, url_filter.rules_frame(spark, rules).limit(0)).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_fingerprint(spark, odd, docs, empty):
    for df in (odd, docs, docs.limit(1)):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in df.select("doc_id", "text").collect())
        got = fingerprint.fingerprint_documents(df).collect()
        by = {}
        for r in got:
            by.setdefault((r.doc_id is not None, r.doc_id or 0), []).append(r)
        assert len(got) == len(rows)
        for k, (key, t) in enumerate(rows):
            follow = rows[(k + 1) % len(rows)][1]
            new = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
            own, ed, nxt = fingerprint.fingerprints([x.encode() for x in (t, new, follow)])
            assert any(
                (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(t), new, fingerprint.written(own), fingerprint.written(ed))
                and abs(r.near_edited - fingerprint.containment(own, ed)) < 1e-12 and abs(r.near_next - fingerprint.containment(own, nxt)) < 1e-12 for r in by[key])
    assert fingerprint.fingerprint_documents(empty).count() == 0


def slow_fingerprint(text):
    """Byte by byte: a rolling gear hash over the batch's last 32 bytes can't be told from one over the text's, which every cut is at least 32 bytes into."""
    data = b" ".join(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()).split())
    gear = []
    for k in range(256):
        z = (k + 1 + 8) * 0x9E3779B97F4A7C15 & (2**64 - 1)
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (2**64 - 1)
        gear.append((z ^ z >> 31) & 0xFFFFFFFF)
    found, start, h = {}, 0, 0
    for i, b in enumerate(data):
        h = (2 * h + gear[b]) & 0xFFFFFFFF
        n = i + 1 - start
        mask = 0xFE000000 if n < 96 else 0xF8000000
        if i + 1 == len(data) or n == 1024 or (n >= 32 and not h & mask):
            found.setdefault(xxhash.xxh64_intdigest(data[start : i + 1]), n)
            start = i + 1
    return found


def test_fingerprints_equal_brute_force(docs):
    texts = [t or "" for _, t in ODD] + [r.text for r in docs.limit(60).collect()]
    assert fingerprint.fingerprints([t.encode() for t in texts]) == [slow_fingerprint(t) for t in texts]


def test_chunks_resist_shifts():
    text = LONG.encode()
    a, b = fingerprint.fingerprints([text, b"some new words in front " + text])
    assert fingerprint.containment(a, b) > 0.9 and fingerprint.read(fingerprint.written(a)) == a
    # the vector form equals the rolling definition
    data = np.frombuffer(text[:3000], np.uint8)
    g, h, out = fingerprint._GEAR, 0, []
    for x in data:
        h = ((h << 1) + int(g[x])) & 0xFFFFFFFF
        out.append(h)
    assert common.gear_hash(g[data]).tolist() == out


def slow_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i + 1000, t) for i, t in ODD if i is not None and i != 5]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string")
    prints = [slow_print(t) for _, t in rows]
    comp = slow_components(prints)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        least[c] = min(i, least.get(c, i))
    want = {i: (p, least[c]) for (i, _), p, c in zip(rows, prints, comp, strict=True)}
    for bucket in (20_000, 3):
        got = simhash.near_duplicates(df, bucket_rows=bucket).select("doc_id", simhash.hex_print().alias("f"), "component_id").collect()
        assert {r.doc_id: (int(r.f, 16), r.component_id) for r in got} == want and len(got) == len(rows)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == set(least.values())
    again = simhash.keep_one(odd).collect()
    assert sum(r.doc_id == 5 for r in again) == 1 and sum(r.doc_id is None for r in again) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_goes_by_row(spark):
    x, y, z = "one text of its own", "quite another one here", "and a third with words"
    for keep in (simhash.keep_one, resemblance.keep_one):
        for rows, want in (([(1, x), (1, z), (0, z)], [x, z]), ([(1, x), (1, y), (2, y)], [x, y]), ([(None, x), (None, x), (3, y), (None, y)], [x, y])):
            got = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert sorted(r.text for r in got) == sorted(want), rows
            assert sorted(r.doc_id for r in got if r.text == y) == [3 if (3, y) in rows else 1][: y in want]


def shingle_set(t):
    w = ascii_lower(t or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for j in range(len(sets)):
        for i in range(j):
            if root[i] != root[j] and (not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return root


def test_near_dedup_links_at_five_words(spark, docs, odd):
    import corpus_pipeline as cp

    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(100)]
    edited = []
    for n in (1, 1, 1, 2, 2, 3, 5) * 6:  # many within a bucket, some linked only over others
        w = list(base)
        for k in rng.sample(range(100), n):
            w[k] = f"new{rng.randrange(10**6)}"
        edited.append(" ".join(w))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate([" ".join(base), *edited])]
    rows += [(None, rows[0][1]), (None, "a text of its own that no other row has"), (None, "a text of its own that no other row has"), (7000, "x y"), (7000, "z y"), (6999, "z y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = slow_groups([t for _, t in rows])
    for stage in (lambda: cp.near_dedup_stage(spark, df, SF), lambda: resemblance.keep_one(df, paired=2), lambda: simhash.keep_one(df, similarity=0.8)):
        kept = [(r.doc_id, r.text) for r in stage().collect()]
        assert len(kept) == len(set(groups))
        want = {g: min((i is None, i or 0) for (i, _), h in zip(rows, groups, strict=True) if h == g) for g in set(groups)}
        assert sorted((i is None, i or 0) for i, _ in kept) == sorted(want.values())
        assert sorted(t for i, t in kept if i in (6999, 7000)) == ["x y", "z y"]
    assert resemblance.keep_one(odd).columns == odd.columns
    with pytest.raises(ValueError, match="0.8"):
        simhash.keep_one(odd, similarity=0.5)
    # a higher similarity links only exact sets
    assert simhash.keep_one(df, similarity=1).count() == len({frozenset(shingle_set(t)) for _, t in rows})


def test_every_close_pair_meets_under_a_mask():
    rng, ms = random.Random(4), [m & (2**64 - 1) for m in simhash.masks()]
    assert len(ms) == 31
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(flip & m == 0 for m in ms)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[n] == min(seen)
    assert got.keys() == near.keys()
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, odd, empty):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs)
    out = quality.score(docs, model)
    held = {r.doc_id: r.quality for r in labels.collect()}  # never seen in training
    right = [(r.keep == (held[r.doc_id] == 1), held[r.doc_id]) for r in out.collect() if r.doc_id in held]
    assert np.mean([x for x, _ in right]) > 0.97 and np.mean([x for x, q in right if q == 1]) > 0.98 and np.mean([x for x, q in right if q == 0]) > 0.9
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {r.doc_id for r in out.filter("keep").collect()}
    assert quality.score(odd, model).count() == len(ODD) and quality.keep_good(odd, model).columns == odd.columns
    none = quality.train(empty)
    assert quality.score(odd, none).filter("keep").count() == len(ODD) and quality.score(empty, none).count() == 0


def test_variety_of_long_texts():
    rng = random.Random(8)
    fresh = lambda n, k: [b"w%d" % rng.randrange(k) for _ in range(n)]
    plain, long, short = fresh(2000, 6000), fresh(3000, 9000), fresh(50, 10**6)
    at = quality.HEURISTICS.index("variety")
    for w in (plain + short * 200, short * 200 + plain, long * 4):  # a passage over and over: behind, in front, longer than a window
        assert quality.votes(b" ".join(w))[at] == quality.JUNK and quality._measures(w)[1] > 0.25
    assert quality.votes(b" ".join(fresh(9000, 6000)))[at] == quality.GOOD
    assert abs(quality.repetition(plain + plain[:1]) - quality.repetition(plain)) < 0.002
    for n in (60, 1999, 2000):
        assert quality.repetition(plain[:n]) == 1 - len(set(plain[:n])) / n


def drawn_votes(seed, n, prior, found, false, silent):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        rates = found if rng.random() < prior else false
        out.append(tuple(quality.ABSTAIN if rng.random() < a else quality.JUNK if rng.random() < p else quality.GOOD for p, a in zip(rates, silent, strict=True)))
    return out


@pytest.mark.parametrize("prior", [0.1, 0.3])
def test_label_model_finds_accuracies(prior):
    found, false, silent = [0.6, 0.5, 0.7, 0.4, 0.5, 0.6, 0.8, 0.5], [0.05, 0.2, 0.1, 0.08, 0.15, 0.06, 0.1, 0.05], [0.0, 0.1, 0.05, 0.3, 0.0, 0.2, 0.1, 0.0]
    counts = collections.Counter(drawn_votes(6, 60_000, prior, found, false, silent))
    m = quality.fit_labels(counts)
    assert abs(m.prior - prior) < 0.03
    for j, (hit, spared, voted) in enumerate(m.accuracies().values()):
        assert abs(hit - found[j]) < 0.06 and abs(1 - spared - false[j]) < 0.03 and abs(1 - voted - silent[j]) < 0.01
    # not merely whether any heuristic said junk
    lone = (quality.GOOD, quality.JUNK, *[quality.GOOD] * 6)
    assert m.junk(lone) < 0.5 < m.junk((quality.JUNK, quality.GOOD, quality.JUNK, quality.GOOD, quality.GOOD, quality.JUNK, quality.JUNK, quality.GOOD))


def slow_em(rows, rounds):
    """Document by document, in plain products."""
    m = len(quality.HEURISTICS)
    silent = [(sum(v[j] == quality.ABSTAIN for v in rows) + 0.01) / (len(rows) + 0.02) for j in range(m)]
    prior, rate = 0.15, [[0.4] * m, [0.02] * m]
    for _ in range(rounds):
        post = []
        for v in rows:
            both = []
            for c, p in ((0, prior), (1, 1 - prior)):
                for j, x in enumerate(v):
                    p *= silent[j] if x == quality.ABSTAIN else (1 - silent[j]) * (rate[c][j] if x == quality.JUNK else 1 - rate[c][j])
                both.append(p)
            post.append(both[0] / sum(both))
        for c in (0, 1):
            q = [p if c == 0 else 1 - p for p in post]
            for j in range(m):
                junk, good = (sum(w for w, v in zip(q, rows, strict=True) if v[j] == k) + 0.01 for k in (quality.JUNK, quality.GOOD))
                rate[c][j] = junk / (junk + good)
        prior = (sum(post) + 0.01) / (len(rows) + 0.02)
    return prior, rate


@pytest.mark.parametrize("rounds", [1, 7])
def test_label_model_equals_brute_force(rounds):
    rows = drawn_votes(2, 300, 0.2, [0.6] * 8, [0.1] * 8, [0.1] * 8)
    prior, rate = slow_em(rows, rounds)
    m = quality.fit_labels(collections.Counter(rows), rounds)
    assert abs(m.prior - prior) < 1e-9
    for c in (0, 1):
        voted = 1 - m.chances[c, :, quality.ABSTAIN]
        assert np.allclose(m.chances[c, :, quality.JUNK] / voted, rate[c], atol=1e-9)


def test_scorer_equals_brute_force():
    """Training step by step over plain lists, and a score as a sum over a text's words."""
    texts = [b"good text with words", b"bad*** text### BAD!!! 12", b"good old words again again", b"x y z *** ***", "é ñ good".encode()]
    goods = [0.99, 0.02, 0.9, 0.1, 0.8]
    rows = [(*quality.sparse(t), g) for t, g in zip(texts, goods, strict=True)]
    weights, bias = quality.fit_scorer(rows, rounds=5)
    scale, w, b = quality.SCALE, [0.0] * quality.FEATURES, 0.0
    sq, sqb = [1e-8] * quality.FEATURES, 1e-8
    good = sum(g >= 0.5 for g in goods)
    for _ in range(5):
        grad, gb = [1e-3 * x for x in w], 0.0
        for at, values, g in rows:
            z = b + sum(v * scale[i] * w[i] for i, v in zip(at, values, strict=True))
            share = 0.5 / (good if g >= 0.5 else len(goods) - good)
            d = (1 / (1 + math.exp(-z)) - g) * share
            gb += d
            for i, v in zip(at, values, strict=True):
                grad[i] += d * v * scale[i]
        for i, g in enumerate(grad):
            if g:
                sq[i] += g * g
                w[i] -= 0.5 * g / math.sqrt(sq[i])
        sqb += gb * gb
        b -= 0.5 * gb / math.sqrt(sqb)
    assert abs(b - bias) < 1e-3 and np.allclose(np.array(w) * scale, weights, atol=2e-3)
    model = quality.Model(quality.fit_labels({}), weights, bias)
    for t in texts:
        at, values = quality.sparse(t)
        assert abs(quality.Scorer(model)(t) - 1 / (1 + math.exp(-(bias + sum(v * weights[i] for i, v in zip(at, values, strict=True)))))) < 1e-9


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)
    assert sorted(df.columns) == sorted(names)


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, SF, "documents")
    left = docs
    for _, stage in cp.STAGES[:-1]:
        new = stage(spark, left, SF)
        assert new.columns == docs.columns
        left = common.stored(new, "stage")
    packed = cp.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}
    assert 0 < left.count() < docs.count()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empties, repeats and clashing columns pass each stage; an empty table stays empty."""
    import corpus_pipeline as cp

    plain = [(100 + i, " ".join(f"Word{(i * 31 + k * 7) % 900} text" for k in range(40))) for i in range(60)]
    rows = [(i, t, *"abcd") for i, t in ODD + plain]
    schema = "doc_id long, text string, row string, id string, __kept string, digest string"
    for name, data in (("odd", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        common.table(spark, SF, "benchmark").write.parquet(f"{sf}/benchmark.parquet")
        docs = common.table(spark, sf, "documents")
        for _, stage in cp.STAGES[:-1]:
            new = stage(spark, docs, sf)
            assert new.columns == docs.columns
            docs = common.stored(new, "stage")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        packed = cp.run(spark, sf).collect()
        assert {r.doc_id for r in packed} == set(ids)
        if data:
            assert ids.count(5) <= 1 and ids.count(10) + ids.count(11) == 1 and sum(i in (1, 2, 3) for i in ids) == 1 and len({r.doc_id for r in packed if (r.doc_id or 0) >= 100}) == 60
        else:
            assert not packed


def test_near_dedup_goes_by_simhash(spark, monkeypatch):
    import corpus_pipeline as cp

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = {0: base, 1: [*base[:700], "changed", *base[701:]], 2: [f"v{rng.randrange(10**6)}" for _ in range(300)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    seen, real = [], simhash.classes

    def spy(prints, *args):
        found = real(prints, *args)
        seen.append({r.fingerprint: r.root for r in found.collect()})
        return found

    monkeypatch.setattr(simhash, "classes", spy)
    assert {r.doc_id for r in cp.near_dedup_stage(spark, df, SF).collect()} == {0, 2}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = {k: simhash.fingerprint(" ".join(v).encode(), 5) for k, v in texts.items()}
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    assert len(seen) == 1 and set(seen[0]) == {signed(f) for f in prints.values()}
    assert seen[0][signed(prints[0])] == seen[0][signed(prints[1])] != seen[0][signed(prints[2])]
    # without any band the classes give the candidates, and the whole sets decide
    sizes = {k: len(resemblance.shingles(" ".join(v).encode())) for k, v in texts.items()}
    entries = spark.createDataFrame([(k, sizes[k], [], k) for k in texts], "entry long, n int, bands array<long>, fingerprint long")
    one = spark.createDataFrame([(k, 0) for k in texts], "fingerprint long, root long")
    for paired in (1, 16):
        assert {(min(r), max(r)) for r in resemblance.links(df.withColumnRenamed("doc_id", "row"), entries, paired, classes=one).collect()} == {(0, 1)}
