"""Operators against brute force, exact round trips and edge cases, on small fixtures."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trussline.llm import ann, lm, media, minhash, mixing, packing, quality, suffix, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, rng, vocabulary=None):
    return " ".join(rng.choice(vocabulary) if vocabulary else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near-copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(11)
    out = [(i, words(rng.randrange(1, 120), rng)) for i in range(80)]
    base = words(100, rng).split()
    for i in range(80, 130):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(["the", "of", words(1, rng)])
        out.append((i, " ".join(w)))
    out += [(130 + i, out[i][1]) for i in range(5)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "One  two"), (205, "one\ntwo"), (206, words(4000, rng)), (207, "é ß " * 30), (209, "a<|endoftext|> b"), (3, out[3][1]), (None, out[3][1]), (208, "a" * 900)]
    return [(d, t, "en", f"src{(d or 0) % 3}" if d != 203 else None, 0) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns whose names clash with those that operators use.
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("n", F.lit("x")).withColumn("key", F.lit(2)).withColumn("score", F.lit(0.5)).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(rows, docs, none, size):
    def shingles(t):
        w = tokens(t)
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    low = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[a]] == low[a] for a in low):
            break
    got = minhash.near_duplicates(docs, shingle=size, percent=80).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((low[r.doc_id], low[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
        assert r.n_shingles == len(sets[r.doc_id if r.doc_id is not None else 3])
    assert minhash.near_duplicates(none, shingle=size).count() == 0


def test_near_duplicates_of_an_id_with_several_texts(spark):
    """Id 5 has the text of id 3 and, in another row, one near id 7's: all three are one component."""
    rng = random.Random(7)
    a, b = words(60, rng), words(60, rng)
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b + " end"), (9, words(60, rng))], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == {(3, 3, True): 1, (5, 3, False): 2, (7, 3, False): 1, (9, 9, True): 1}


@pytest.mark.parametrize("width", [20, 400])
def test_suffix_dedup(rows, docs, none, width):
    count = collections.Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    want = collections.Counter()
    for d, t, *_ in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone.update(range(i, i + width))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        want[d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in suffix.suffix_dedup(docs, width=width).collect()) == want
    assert suffix.suffix_dedup(none, passages=51).count() == 0


def test_suffix_dedup_of_an_id_with_several_texts(spark):
    """A text that occurs once keeps all its bytes, though its id stands on copies too; null ids are documents of their own."""
    rng = random.Random(13)
    a, b, c = (words(90, rng) for _ in range(3))
    docs = spark.createDataFrame([(5, a), (5, b), (6, a), (None, c), (None, c), (None, b[:300])], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.suffix_dedup(docs, width=100).collect())
    assert got == {(5, len(a), len(a)): 1, (5, len(b), 300): 1, (6, len(a), len(a)): 1, (None, len(c), len(c)): 2, (None, 300, 300): 1}


def test_shared_passages(spark):
    """Every text with a passage of 51 words that occurs elsewhere has an anchor in common; the others have none."""
    rng = random.Random(14)
    passages = [words(51, rng).split() for _ in range(30)]
    rows, want = [], {}
    for i in range(200):
        w = words(rng.randrange(20, 150), rng, [f"{rng.random():.6f}" for _ in range(400)]).split()
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passages[i % 30]
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    seen = collections.Counter(g for _, t in rows for g in {tuple(t.split()[i : i + 51]) for i in range(len(t.split()) - 50)})
    for i, t in rows:
        want[i] = any(seen[tuple(t.split()[j : j + 51])] > 1 for j in range(len(t.split()) - 50))
    got = suffix.suffix_dedup(spark.createDataFrame([*rows, (900, None)], "doc_id long, text string").repartition(3), passages=51).collect()
    assert {r.doc_id: r.shared_passages > 0 for r in got} == {**want, 900: False} and any(want.values())


def test_anchors_of_texts_longer_than_a_segment(monkeypatch):
    """Every window belongs to one anchor, the least gram of it, wherever segments of a long text end."""
    rng = np.random.default_rng(2)
    data, width, half = rng.integers(97, 101, 3000).astype(np.uint8), 40, 20
    offs = np.array([0, 30, 30, 1900, 3000])
    whole = suffix.anchors(data, offs, width)
    monkeypatch.setattr(suffix, "PLACE_BITS", 9)
    monkeypatch.setattr(suffix, "SEGMENT", 511)
    doc, at, high, low, name, *_ = suffix.anchors(data, offs, width)
    covered = collections.Counter((d, p - k) for d, p, h, lo in zip(doc.tolist(), at.tolist(), high.tolist(), low.tolist(), strict=True) for k in range(lo, h + 1))
    assert covered == {(d, i): 1 for d in range(4) for i in range(max(0, offs[d + 1] - offs[d] - width + 1))}
    grams = collections.defaultdict(set)
    for d, p, n in zip(doc.tolist(), at.tolist(), name.tolist(), strict=True):
        grams[data[offs[d] + p : offs[d] + p + half].tobytes()].add(n)
    assert all(len(v) == 1 for v in grams.values()) and len(set(name.tolist())) == len(grams) and len(whole[0]) <= len(doc)


def test_quality_of_a_very_long_text():
    """Tens of thousands of lines in one text, beside an empty one."""
    text = b"".join(b"Line %d is a good one.\n" % i for i in range(30_000))
    field = quality.Field(np.ones(3 * quality.OWN + 3) / 10, np.array([[1.0, 0.0], [0.0, 1.0]]), (1.0, 0.0), 0.25)
    got = field.score(np.frombuffer(text, np.uint8), np.array([0, len(text), len(text)]))
    assert 0 < got[0] < 1 and got[1] == 0.25


def test_suffix_dedup_splits_names_of_many_contexts(spark, monkeypatch):
    """A passage with other surroundings in every document: names with more contexts than a block holds are split by windows."""
    monkeypatch.setattr(suffix, "BLOCK", 8)
    tables, write = [], suffix.written
    monkeypatch.setattr(suffix, "written", lambda df, name: tables.append(name) or write(df, name))
    rng, width = random.Random(3), 40
    passage = words(30, rng)
    texts = [f"{words(12, rng)} {passage[: len(passage) - i % 3]}\0{words(12, rng)}" for i in range(60)]
    texts += [texts[0], passage + "é", words(40, rng)]
    raw = [t.encode() for t in texts]
    count = collections.Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    want = []
    for d, b in enumerate(raw):
        gone = {j for i in range(len(b) - width + 1) if count[b[i : i + width]] > 1 for j in range(i, i + width)}
        want.append((d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    got = suffix.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), width=width).collect()
    assert sorted(map(tuple, got)) == want
    assert "windows" in tables


def test_packing(rows, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs, size=64).collect()
    by_row = collections.defaultdict(list)
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        by_row[d].append([(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    want = collections.Counter((d, *p) for d, lists in by_row.items() for ps in lists for p in ps)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(seq) <= -(-sum(r.length for r in got) // 64) + 3
    assert packing.best_fit_packing(none).count() == 0


def test_packing_rounds(spark, monkeypatch):
    """Several rounds of a tree give full bins too."""
    monkeypatch.setattr(packing, "PER_TASK", 50)
    rng = random.Random(4)
    sizes = [rng.randrange(1, 1024) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    got = packing.pack_lengths(items).join(items, "item").collect()
    assert sorted(r.item for r in got) == list(range(600))
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    # Partitions of 50 items lose some tightness against one best-fit pass over all 600; production ones have 100,000.
    assert len(seq) <= 1.06 * (packing.best_fit(np.array(sizes), 1024).max() + 1)


def test_ids_are_the_tokenizer_files():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = packing.tokenizer(None)
    rng = random.Random(1)
    pool = [*"abcXYZ012 ,.'!?\n\t_-é߀ü½²x’“日\x1c\u00a0\u2003'll's  ", "<|endoftext|>", "<|", "endoftext", "|>", "the", " and", "\r\n", "\u200d", "😀"]
    for _ in range(600):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_mixing(rows, docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(tokens(t))
    order = [*sorted(x for x in size if x is not None), *([None] if None in size else [])]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, clamped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in clamped)
        share = sum(weight[s] for s in order if s not in clamped)
        target = {s: 3 * size[s] if s in clamped else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        clamped |= over
    source = {(d, len(tokens(t))): s for d, t, _, s, _ in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("rows", [[("a", "x y z"), ("b", ""), ("b", None), ("c", "u v")], [("a", None), ("b", "one two three"), (None, "four")], [("a", "")], [("a", None), ("b", " ")]])
def test_mixing_sources_without_words(spark, rows):
    """A source of empty or null texts has size and target 0, beside sound ones or alone."""
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    size = collections.Counter()
    for s, t in rows:
        size[s] += len(tokens(t))
    assert len(got) == len(rows) and all(got[i].source_size == size[s] for i, (s, _) in enumerate(rows))
    for i, (s, t) in enumerate(rows):
        assert 0 <= got[i].taken <= 3 * len(tokens(t)) and (size[s] or got[i].target == 0)
    assert sum(r.taken for r in got.values()) == pytest.approx(sum({s: got[i].target for i, (s, _) in enumerate(rows)}.values()), abs=len(size))


def test_media(rows, docs, none):
    for raw in (b"", b"a" * 191, bytes(range(256)) * 300, b"x" * 192 * 17):
        p = media.padded(raw)
        m = media.read_media(media.write_media(p))
        assert media.payload_of(media.write_media(p), m) == p and m["codec"] == "raw " and m["duration"] == len(p) / media.RATE
    want = collections.Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        p = media.padded(raw)
        want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    got = media.text_media(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.text_media(none).count() == 0


def _track(number, handler, codec, scale, *tables):
    u = struct.pack
    entry = media.full(b"stsd", u(">I", 1), media.box(codec, b"\0" * 16))
    return media.box(b"trak", media.full(b"tkhd", u(">III", 0, 0, number)), media.box(b"mdia", media.full(b"mdhd", u(">IIII", 0, 0, scale, 0)), media.full(b"hdlr", u(">I4s", 0, handler)), media.box(b"minf", media.box(b"stbl", entry, *tables))))


def test_media_tracks_and_fragments():
    """A sound track before a video track, and samples in fragments with sizes, defaults and key flags."""
    u = struct.pack
    tables = lambda at, sizes, keys: (media.full(b"stts", u(">III", 1, len(sizes), 10)), media.full(b"stsc", u(">IIII", 1, 1, len(sizes), 1)), media.full(b"stsz", u(">II", 0, len(sizes)), *[u(">I", z) for z in sizes]), media.full(b"stco", u(">II", 1, at)), *([media.full(b"stss", u(">I", len(keys)), *[u(">I", k) for k in keys])] if keys else []))
    film = media.box(b"moov", _track(1, b"soun", b"mp4a", 100, *tables(40, [5, 6], [])), _track(2, b"vide", b"avc1", 10, *tables(60, [7, 8, 9], [1, 3]))) + media.box(b"mdat", b"x" * 300)
    sound, video = media.read_tracks(film)
    assert (sound["kind"], sound["codec"], sound["duration"], sound["start"].tolist()) == ("soun", "mp4a", 0.2, [40, 45])
    assert media.read_media(film)["codec"] == "avc1" and video["keys"].tolist() == [0, 2] and video["start"].tolist() == [60, 67, 75] and video["duration"] == 3.0
    head = media.box(b"moov", _track(7, b"vide", b"hvc1", 10, media.full(b"stsz", u(">II", 0, 0)), media.full(b"stsc", u(">I", 0)), media.full(b"stco", u(">I", 0))), media.box(b"mvex", media.full(b"trex", u(">IIIII", 7, 1, 5, 20, 0x10000))))
    run = media.full(b"trun", u(">IiI", 3, 80, 0), u(">III", 11, 12, 13), flags=0x205)
    part = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u(">I", 7), flags=0x20000), run, media.full(b"trun", u(">I", 2))))
    (t,) = media.read_tracks(head + part + media.box(b"mdat", b"y" * 200))
    at = len(head) + 80
    assert t["start"].tolist() == [at, at + 11, at + 23, at + 36, at + 56] and t["size"].tolist() == [11, 12, 13, 20, 20]
    assert t["keys"].tolist() == [0] and t["duration"] == 2.5 and t["kind"] == "vide"


def test_media_columns(spark):
    good = media.write_media(media.padded(b"hello" * 1000))
    at = good.index(b"stsz") + 8
    huge = good[: at + 4] + b"\xff\xff\xff\xff" + good[at + 8 :]
    files = spark.createDataFrame([("a", bytearray(good), 1), ("b", bytearray(good[:-5]), 1), ("c", bytearray(b"junk"), 1), ("d", None, 1), ("e", bytearray(huge), 1)], "path string, content binary, media int")
    got = {r.path: r.media for r in media.media_columns(files).collect()}
    assert got["a"][0].samples == 27 and [k.size for k in got["a"][0].keyframes] == [192] * 4
    assert all(got[k] is None for k in "bcde")


def test_urls(spark):
    u = ["http://a.com/x", "http://example.com/en/1", "https://WWW.Example.com/en/1?q", "http://b.net/es/", "http://b.net/fr/z", "http://b.net/en/", "http://netx/es/", "x://com/", "nope", None, "http://c.org?x/y", "http://com"]
    got = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame([(i, x, "h", 1) for i, x in enumerate(u * 30)], "page_id long, url string, host string, p int")).collect()}
    rule = ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, "com/", None, None, None, None]
    assert [got[i].rule for i in range(len(u))] == rule
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 7)] == ["allow", "block", "allow", "block", "block", "allow"]
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[2].host == "www.example.com" and got[9].host == "" and got[10].path == ""
    assert [got[i].verdict for i in range(len(u))] == [got[i + len(u)].verdict for i in range(len(u))]
    assert {r.verdict for r in urls.url_verdicts(spark.createDataFrame([(1, "x.org"), (2, None)], "page_id long, url string")).collect()} == {"allow"}


def test_suffix_statistics_are_out_of_fold(spark):
    """A labelled URL's suffix statistics leave out its fold; others see all; rare suffixes have the overall share."""
    rows = [(i, "net" if i < 40 else "rare", float(i % 2) if i < 30 or i == 40 else None) for i in range(42)]
    got = {r.x: r for r in urls._with_suffix(spark.createDataFrame(rows, "x long, s1 string, label double"), "s1", 0.25).collect()}
    for x, _, label in rows[:40]:
        own = [y for i, _, y in rows[:30] if label is None or i % urls.FOLDS != x % urls.FOLDS]
        assert got[x].f_s1_n == pytest.approx(np.log1p(len(own))) and got[x].f_s1_rate == pytest.approx((sum(own) + urls.PRIOR * 0.25) / (len(own) + urls.PRIOR))
    assert got[41].f_s1_n == 0 and got[41].f_s1_rate == pytest.approx(0.25)


def test_url_trees_learn(spark):
    rng = random.Random(2)
    pages = [(i, f"http://{w}.zz.net/{'es' if bad else 'en'}/{rng.randrange(99)}" if i % 2 else f"http://{w}.org/{'es' if bad else 'en'}/{rng.randrange(99)}", bad) for i in range(600) for bad in [rng.random() < 0.5] for w in ["cheap-pills-win" if bad else "home"]]
    rules = (("block", "net/es/"), ("allow", "net/en/"))
    got = {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, bad boolean"), rules).collect()}
    assert np.mean([(got[i] == "block") == bad for i, _, bad in pages if i % 2 == 0]) > 0.95
    unseen = {r.page_id: r.predicted for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, bad boolean"), rules, learn=F.col("page_id") % 4 == 1).collect()}
    assert np.mean([(unseen[i] == "block") == bad for i, _, bad in pages if i % 4 == 3]) > 0.95


def test_lm(rows, docs, none):
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    count = collections.Counter()
    for d, t, *_ in rows:
        if not out(d):
            count.update([*tokens(t), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for d, t, *_ in rows:
        w = [*tokens(t), None]
        want[d, out(d), len(w), sum(count[x] > 0 for x in w), n, round(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    got = lm.lm_scores(docs, held).collect()
    assert collections.Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.lm_scores(none, held).count() == 0


@pytest.mark.parametrize(("depth", "context", "symbol", "hot"), [(lm.DEPTH, lm.CONTEXT, lm.SYMBOL, lm.HOT), (3, 4, 2, 40), (2, 2, 1, 0)])
def test_lm_scores_equal_a_brute_force_tree(spark, monkeypatch, depth, context, symbol, hot):
    """Contexts of every length, words and contexts not seen at all, and entries that are broadcast, joined, or both."""
    for name, v in (("CONTEXT", context), ("SYMBOL", symbol), ("HOT", hot), ("HOT_COUNT", 3), ("GATHER", 5000), ("SALTED_SHARE", 0.01), ("PER_SLICE", 3000)):
        monkeypatch.setattr(lm, name, v)
    rng = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(common) for _ in range(40)) + f" p{i % 100} q{i % 100} r{i % 100} " + rng.choice(["a b c d e f g", "a c b d e g f", "b a c"]) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "p7 q7 r7 never q9 r9 a b"), (1001, None), (1002, "b c p3 w1 w2 q3 r3"), (1003, "a b c d e f g a b c d e g")]
    train = [[None, *tokens(t), None] for _, t in rows[:600]]
    uni = collections.Counter(x for r in train for x in r[1:])
    n, v = sum(uni.values()), len(uni)
    after = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for r in train:
        for d in range(1, depth + 1):
            for i in range(d, len(r)):
                after[d][tuple(r[i - d : i])][r[i]] += 1
    state = {}

    def p(c, x):
        if not c:
            return (uni[x] + 0.1) / (n + 0.1 * (v + 1))
        if c not in state:
            return p(c[1:], x)
        total, kept = state[c]
        return (kept.get(x, 0) + (total - sum(kept.values()) + lm.KAPPA) * p(c[1:], x)) / (total + lm.KAPPA)

    for d in range(1, depth + 1):
        for c, nxt in after[d].items():
            total, kept = sum(nxt.values()), {x: k for x, k in nxt.items() if k >= symbol}
            other = total - sum(kept.values())
            gain = sum(k * np.log(k / total / p(c[1:], x)) for x, k in kept.items())
            if other:
                gain += other * np.log(other / total / (1 - sum(p(c[1:], x) for x in kept)))
            if total >= context and kept and gain > lm.DIVERGENCE * np.log(n):
                state[c] = (total, kept)
    assert {len(c) for c in state} >= set(range(1, min(depth, 3) + 1))
    for c in list(state)[:20]:  # a state's probabilities, that of the unknown word included, add up to 1
        assert sum(p(c, x) for x in [*uni, "never"]) == pytest.approx(1.0)
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") >= 1000, depth=depth).collect()}
    for i, t in rows[:40] + rows[600:]:
        w = [None, *tokens(t), None]
        assert got[i].score == pytest.approx(sum(np.log10(p(tuple(w[max(0, j - depth) : j]), w[j])) for j in range(1, len(w))), abs=1e-8)
    assert sum(got[i].score for i in range(600)) > sum(got[i].base_score for i in range(600))


def test_graph_is_built_and_searched_by_walking():
    """Insertion in several batches; a search looks at a part of the graph and finds most of the nearest; links stay in range."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 32)).astype(np.float32)
    g = ann.build_graph(np.arange(6000), v)
    own = np.frombuffer(g["vectors"], np.float32).reshape(-1, 32)
    layers = [np.frombuffer(x["links"], np.int32).reshape(x["nodes"], -1) for x in g["layers"]]
    assert len(layers) > 2 and all(x.max() < len(x) and (x != np.arange(len(x))[:, None]).all() for x in layers)
    looked: list[int] = []
    found = ann.beam(own, layers[-1], own[:200], ann.descend(own, layers[:-1], own[:200]), 96, visited=looked)
    s = own[:200] @ own.T
    hits = np.take_along_axis(s, found[:, :20], 1) >= -np.sort(-s, axis=1)[:, 19:20] - 1e-5
    assert hits.mean() > 0.95 and sum(looked) / 200 < 0.4 * len(own)


@pytest.mark.parametrize("shard", [ann.SHARD, 300])
def test_nearest(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 24)) * rng.random((1500, 1))
    v[700:760] = v[40]
    rows = [(i, [float(np.float32(x)) for x in r], 1) for i, r in enumerate(v)]
    rows += [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] + [1.0] * 23, 0), (5060, [None] + [1.0] * 23, 0), (5080, [], 0), (None, rows[3][1], 0), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = np.array([r[1] for r in rows[:1500]])
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert np.allclose([s[i] for _, i, _ in found], [z for *_, z in found], atol=1e-12, rtol=0)
        s[q] = -np.inf
        hits += sum(z >= np.sort(s)[-20] - 1e-12 for *_, z in found)
    assert hits >= 0.9 * 20 * len(got)
    assert [r.vec_id for r in ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).orderBy("rank").collect()] in ([1, 2], [2, 1])
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def brute_marginals(emit, trans):
    n = len(emit)
    paths = [[(p >> i) & 1 for i in range(n)] for p in range(1 << n)]
    score = np.array([sum(emit[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
    p = np.exp(score - score.max())
    p /= p.sum()
    return [sum(q for q, y in zip(p, paths, strict=True) if y[i]) for i in range(n)]


def test_forward_backward():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 8, 9])
    emit, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    good, joint, _ = quality.marginals(emit, trans, first, pairs=True)
    want = [m for a, b in zip(first, first[1:], strict=False) if b > a for m in brute_marginals(emit[a:b], trans)]
    np.testing.assert_allclose(good, want)
    np.testing.assert_allclose(joint.sum((1, 2)), np.maximum(np.diff(first) - 1, 0))


def test_quality_gradient_and_transitions():
    """The gradient of the hidden-label likelihood equals finite differences; from documents' labels alone the field learns that lines keep their kind."""
    rng = np.random.default_rng(4)
    first = np.array([0, 3, 3, 8, 9, 15])
    x, y = rng.normal(size=(15, 4)), np.array([1, 0, 0, 1, 1])
    w, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    _, gw, gt = quality.slope(x, first, y, w, trans)
    e = 1e-6
    for i in range(4):
        d = np.eye(4)[i] * e
        assert gw[i] == pytest.approx((quality.slope(x, first, y, w + d, trans)[0] - quality.slope(x, first, y, w - d, trans)[0]) / (2 * e), abs=1e-6)
        assert gt.ravel()[i] == pytest.approx((quality.slope(x, first, y, w, trans + d.reshape(2, 2))[0] - quality.slope(x, first, y, w, trans - d.reshape(2, 2))[0]) / (2 * e), abs=1e-6)
    lines, labels = [], []
    for _ in range(300):
        good = rng.random() < 0.5
        kinds = [int(good)] * 6 + [int(not good)] * int(rng.integers(0, 4)) + [int(good)] * 4
        lines.append(np.array([[k + 0.8 * rng.normal(), 1.0] for k in kinds]))
        labels.append(int(good))
    first = np.concatenate([[0], np.cumsum([len(z) for z in lines])])
    f = quality.fit(np.concatenate(lines), np.ones(first[-1]), first, np.array(labels))
    assert f.trans[0, 0] + f.trans[1, 1] > f.trans[0, 1] + f.trans[1, 0] + 0.5 and f.weights[0] > 0


def test_toxicity_learns_ordered_grades():
    """Four grades: gradient against finite differences, and thresholds that give the grades back."""
    rng = np.random.default_rng(5)
    doc, col = np.repeat(np.arange(40), 3), rng.integers(0, 6, 120)
    val, grade = rng.random(120), rng.integers(0, 4, 40)
    w, raw = rng.normal(size=6), rng.normal(size=3) / 2
    _, gw, gr = toxicity.slope(doc, col, val, grade, w, raw)
    e = 1e-6
    for i in range(6):
        d = np.eye(6)[i] * e
        assert gw[i] == pytest.approx((toxicity.slope(doc, col, val, grade, w + d, raw)[0] - toxicity.slope(doc, col, val, grade, w - d, raw)[0]) / (2 * e), abs=1e-6)
    for i in range(3):
        d = np.eye(3)[i] * e
        assert gr[i] == pytest.approx((toxicity.slope(doc, col, val, grade, w, raw + d)[0] - toxicity.slope(doc, col, val, grade, w, raw - d)[0]) / (2 * e), abs=1e-6)
    y = rng.choice([0, 2, 3, 7], 800)
    words_ = [np.concatenate([np.arange(20), np.repeat(100 + np.arange(4), k)]) for k in y]
    s = toxicity.fit(np.repeat(np.arange(800), [len(z) for z in words_]), np.concatenate(words_).astype(np.int64), np.ones(sum(map(len, words_)), int), y)
    assert s.grades.tolist() == [0, 2, 3, 7] and (np.diff(s.theta) > 0).all()


def test_toxicity_of_graded_labels(spark):
    rng = random.Random(12)
    bad = ["moron", "scum", "vermin"]
    rows = [(i, words(30, rng) + " " + " ".join(rng.choice(bad) for _ in range(4 * (i % 3)))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 3) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.severity(spark.createDataFrame(rows, "doc_id long, text string"), labels, _held()).collect()
    on = [r for r in got if r.held_out]
    assert np.mean([r.grade == r.doc_id % 3 for r in on]) > 0.8 and {r.grade for r in on} == {0, 1, 2}
    mean = [np.mean([r.expected_severity for r in on if r.doc_id % 3 == g]) for g in range(3)]
    assert mean[0] < 0.3 and mean[0] < mean[1] < mean[2] and mean[2] > 1.5


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        lines = [words(8, rng).capitalize() + "." for _ in range(rng.randrange(1, 6))]
        if bad:
            lines = [" | ".join(x.split()) for x in lines]
        if toxic:
            lines[-1] = f"you {rng.choice(['moron', 'scum'])} " + lines[-1] + f" {rng.choice(['moron', 'scum'])}"
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, "x")]
    labels += [(5000, 1, 1), (1, None, None), (None, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _held():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def test_quality(labelled):
    docs, labels = labelled
    got = quality.document_quality(docs, labels, _held()).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    on = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in on]) > 0.95
    assert {r.score for r in quality.document_quality(docs, labels.limit(0), _held()).collect()} == {0.5}
    assert quality.document_quality(docs.limit(0), labels, _held()).count() == 0


def test_toxicity(labelled):
    docs, labels = labelled
    got = toxicity.severity(docs, labels, _held()).collect()
    assert len(got) == 404 and all(0 <= r.expected_severity <= 1 for r in got)
    on = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in on]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    assert {r.predicted for r in toxicity.severity(docs, labels.limit(0), _held()).collect()} == {0}
    assert toxicity.severity(docs.limit(0), labels, _held()).count() == 0


def test_pipeline(spark, rows, docs, labelled, tmp_path):
    import corpus_pipeline as P

    sf = str(tmp_path)
    labelled[1].write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"]
    clash = ("score", "predicted", "gone", "kept_text", "size", "taken", "held_out", "h", "more")
    cur = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("x") for c in clash})
    for i, (_, stage) in enumerate(P.STAGES):
        nxt = stage(spark, cur, sf)
        nxt.write.parquet(f"{sf}/s{i}")
        nxt = spark.read.parquet(f"{sf}/s{i}")
        if i < 4:
            assert nxt.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
            assert nxt.where("score <> 'x' or kept_text <> 'x' or taken <> 'x'").isEmpty()
        if i == 0:
            assert nxt.where("text is null").count() == 1 and nxt.where("doc_id = 201").count() == 1
        if i == 1:
            kept = {r.doc_id for r in minhash.near_duplicates(cur).where("kept").collect()}
            assert {r.doc_id for r in nxt.collect()} == kept
        if i == 3:
            want = mixing.mix_sources(cur).agg(F.sum("taken")).first()[0]
            assert sum(len(tokens(r.text)) for r in nxt.collect()) == want
        cur = nxt
    assert cur.count() > 0 and P.run(spark, sf).count() == cur.count()
