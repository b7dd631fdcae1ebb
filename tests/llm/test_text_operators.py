"""The text operators against brute force, round trips and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe, gif, jaccard_join, mixing, multiset_hash, queries, rule_ensemble, sharding, site_tree, suffix_dedup, token_coder
from rasterloom.llm.common import mix64, table, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, doc string, h long, node long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, ties, repeated rows, a long text, and clashing names."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    base = " ".join(word() for _ in range(300))
    texts = [None, "", base, base, base + " end", " ".join(word() for _ in range(9000)), "ü" * 100 + base[:200], "one two", "a\x0bb  c", "<|endoftext|> hello"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), "s", "d", 1, 2, "l") for i, t in enumerate(texts)]
    rows += [rows[2], rows[7], (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_gif_round_trip_and_rules():
    rng = np.random.default_rng(2)
    for n in (1, 5, 576, 3000):
        data = rng.integers(0, 7, (3, n)).astype(np.uint8)
        streams = gif.lzw_encode_frames(data)
        assert gif.lzw_decode_many(streams, 8, [n] * 3) == [r.tobytes() for r in data]
        assert [gif.lzw_decode(s, 8, n) for s in streams] == [r.tobytes() for r in data]
    long = bytes(rng.integers(0, 256, 20000).astype(np.uint8))
    assert gif.lzw_decode(gif.lzw_encode(long), 8, len(long)) == long
    # two frames: the second is transparent but for one pixel, then the first spot is cleared
    palette = bytes([9, 9, 9, 200, 0, 0])
    image = lambda x, y, w, h, px: b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + b"\0\x02" + gif._blocks(gif.lzw_encode(bytes(px), 2))
    control = lambda disposal, hidden: b"\x21\xf9\x04" + bytes([disposal << 2 | (hidden >= 0), 7, 0, max(hidden, 0)]) + b"\0"
    media = b"GIF89a\x02\0\x02\0\x80\0\0" + palette + control(1, -1) + image(0, 0, 2, 2, [0, 0, 0, 0]) + control(2, 0) + image(0, 0, 2, 1, [0, 1]) + control(0, -1) + image(1, 1, 1, 1, [1]) + b"\x3b"
    first, second, third = gif.decode(media)
    assert first["canvas"][0, 0].tolist() == [9, 9, 9, 255] and second["canvas"][0].tolist() == [[9, 9, 9, 255], [200, 0, 0, 255]]
    assert third["canvas"][0, :, 3].tolist() == [0, 0] and third["start_ms"] == 140
    assert isinstance(gif.decode_many([None, b"no gif"])[0], str)


def test_gif_query(odd, empty):
    got = gif.digests(gif.store(odd)).collect()
    assert len(got) == odd.count() and gif.digests(gif.store(empty)).count() == 0
    want = {r.doc_id: gif.payload_of(r.text or "") for r in odd.collect()}
    for r in got:
        p = want[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    frames = gif.frames(gif.store(odd.filter("doc_id = 2"))).collect()
    assert sum(f.delay_ms for f in frames) and all(sum(f.hist_r) == gif.FRAME for f in frames)


def test_gif_frames_of_odd_media(spark, odd):
    stored = gif.store(odd)
    kind = stored.schema["media"].dataType.simpleString()
    bad = stored.withColumn("media", F.when(F.col("doc_id") == 2, F.lit(None)).when(F.col("doc_id") == 7, F.lit(b"GIF89a broken")).otherwise(F.col("media")).cast(kind))
    whole, left = gif.frames(stored), gif.frames(bad)
    assert left.columns == whole.columns
    assert {r[0] for r in left.select("doc_id").distinct().collect()} >= {r[0] for r in whole.filter("doc_id NOT IN (2, 7)").select("doc_id").distinct().collect()}


def brute_repeats(rows):
    seen, out = {}, []
    for k, t in sorted(rows, key=lambda r: 2**63 if r[0] is None else r[0]):
        data = t.encode()
        mark = np.zeros(len(data), dtype=bool)
        for j in range(len(data) - 49):
            if seen.setdefault(data[j : j + 50], k) != k:
                mark[j : j + 50] = True
        out.append((k, int(mark.sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~mark].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(odd, empty):
    got = sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(odd).collect()), key=str)
    assert got == brute_repeats([(r.doc_id, r.text or "") for r in odd.collect()])
    assert suffix_dedup.digests(empty).count() == 0
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()


def test_suffix_dedup_keeps_rows_of_one_id_apart(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, other = text(12), text(12)
    rows = [(3, text(20) + shared), (4, other + text(9)), (None, text(15) + shared + text(15)), (None, text(60)), (None, text(9)), (None, shared)]
    rows += [(7, text(40) + other), (7, text(30)), (7, text(8) + other), (7, rows[0][1]), (9, shared + text(5)), rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(df).collect()), key=str)
    want = brute_repeats(rows)
    assert got == want
    cut = suffix_dedup.without_repeats(df).collect()
    assert sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in cut), key=str) == sorted(((k, h) for k, _, h in want), key=str)


def test_bucket_pointers_order():
    data = np.frombuffer(b"abracadabra" * 9, dtype=np.uint8)
    p = suffix_dedup.bucket_pointers(data, 50)
    t = data.tobytes() + b"\0" * 50
    windows = [t[i : i + 50] for i in range(len(data) - 50)]
    for i in range(len(windows) - 1):
        assert (p[i] < p[i + 1]) == (windows[i] < windows[i + 1])


def test_site_tree(spark, odd):
    page = "<html><body><nav>menu</nav><article><h1>T &amp; x</h1><p>a  <b>b</b>c<br>d<p>e</article><div class='comments'>no</div><footer>f</footer>"
    rows = [(i, f"http://h{i % 2}/x", p) for i, p in enumerate([page, None, "", "<p>only <i>text</i>", "<script>var a='</p>'</script><div>x</div>"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    assert got == {0: "T & x a bc d e", 1: "", 2: "", 3: "only text", 4: "x"}
    # without semantics a branch that never changes on a host goes
    many = [(i, "http://h/x", f"<html><body><div class=c><div class=top><p>Same links</p></div><div class=in><p>text {i}</p></div></div>") for i in range(12)]
    texts = {r.text for r in site_tree.extract(spark.createDataFrame(many, "page_id long, url string, html string")).collect()}
    assert texts == {f"text {i}" for i in range(12)}


def test_site_tree_raw_text_ends_at_its_own_tag():
    scripts = ["for(i=0;i<n;i++){f(i);}", "if(a<b)g('</p>')", 'var t="<a href=\'x";', "x<!--y"]
    for s in scripts:
        for end in ("</script>", "</SCRIPT >", "</script\n>"):
            page = f"<html><head><script>{s}{end}<style>a<b{{}}</style></head><body><article><p>body</p><script>{s}{end}<p>more</p></article>"
            assert site_tree.main_text(site_tree.parse(page)) == "body more"
    assert site_tree.main_text(site_tree.parse("<p>seen</p><script>i<n; never closed <p>no</p>")) == "seen"


def test_site_tree_decides_inside_articles(spark):
    page = "<html><body><article><h1>Head {0}</h1><div class=box><p>{1}</p></div><div class=in><p>text {0}</p></div></article>"
    # a page whose text at the repeated place is its own keeps it
    same = [page.format(i, "Follow us") for i in range(40)] + [page.format(40, "Own words")]
    # few articles, each copied: nothing is known to be repeated
    copies = ["<html><body><main><div class=a><p>One article, copied</p></div></main>"] * 30
    # the body stands in a div, only teasers are articles
    teasers = ["<html><body><div class=t><article><p>Teaser</p></article></div>" + f"<div class=b><p>The long body of page {i}, with words</p></div>" for i in range(12)]
    rows = [(i, f"http://{h}/x", t) for h, pages in (("a", same), ("b", copies), ("c", teasers)) for i, t in enumerate(pages)]
    got = {(r.url, r.page_id): r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got["http://a/x", i] for i in range(41)] == [f"Head {i} text {i}" for i in range(40)] + ["Head 40 Own words text 40"]
    assert {got["http://b/x", i] for i in range(30)} == {"One article, copied"}
    assert [got["http://c/x", i] for i in range(12)] == [f"The long body of page {i}, with words" for i in range(12)]


def test_site_tree_words_are_a_prior(spark):
    whole = [
        '<html class="has-sidebar"><body class="post no-sidebar"><div class="has-sidebar" id="header"><article><p>a</p></article></div>',
        '<body><main class="share"><article class="comments-closed"><p>a</p></article></main>',
        '<body><article><h2 id="side-effects">a</h2></article>',
        '<body><article><section id="discussion"><p>a</p></section></article>',
    ]
    for page in whole:
        assert site_tree.main_text(site_tree.parse(page)) == "a"
    cards = '<body><div class="related"><article>x</article></div><article><p>text</p><div class="share">no</div></article>'
    assert site_tree.main_text(site_tree.parse(cards)) == "text"
    # the tree contradicts a word if a branch's texts differ, and confirms it if they don't
    pages = [f"<html><body><div class=widget><p>body {i}</p></div><div class=share><p>Share this</p></div>" for i in range(12)]
    rows = [(i, "http://h/x", t) for i, t in enumerate(pages)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"body {i}" for i in range(12)}


def test_site_tree_odd_pages(spark):
    deep = "<div>" * 30000 + "deep" + "<span>" * 30000 + "est"
    rows = [(1, None, None, 1, 2), (1, "http://h/x", deep, 1, 2), (1, "http://h/x", deep, 1, 2), (None, "no url", '<p title="x>open</p>', 1, 2), (4, "http://h/y", "<p title=\"a>b\">" + "long " * 40000, 1, 2), (5, "http://h/z", "<p>a<b>b</p>c", 1, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int, host int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in site_tree.extract(df).collect())
    long = ("long " * 40000).strip()
    assert got == sorted([(1, "", 0), (1, "deepest", 7), (1, "deepest", 7), (0, "open", 4), (4, long, len(long)), (5, "ab c", 4)])
    assert site_tree.extract(df.limit(0)).count() == 0


def brute_importance(pages):
    """Texts of low paths by definition, for pages (all of different main text) of one host."""
    from collections import Counter
    from math import log2

    found = [site_tree.styles(site_tree.parse(p))[1] for p in pages]
    paths = {p for f in found for p in f}
    worth = {}
    for p in paths:
        own = [f[p] for f in found if p in f]
        both = []
        for i in (0, 1):
            n, counts = len(own), Counter(x[i] for x in own)
            h = sum(-c / n * log2(c / n) for c in counts.values())
            both.append(0.0 if i == 1 and set(counts) == {""} else h / log2(n) if n > 1 else 1.0)
        worth[p] = max(both) + site_tree.DOUBT / len(own)
    low = {p for p in paths if worth[p] < site_tree.LOW and p.count("/") > 2 and not any(q.startswith(p + "/") and worth[q] >= site_tree.LOW for q in paths)}
    return {p: {t for t, c in Counter(f[p][1] for f in found if p in f).items() if t and c > 1 and c >= site_tree.SHARED * sum(p in f for f in found)} for p in low}


def test_site_tree_importance_by_definition(spark):
    rnd = random.Random(4)
    pages = []
    for i in range(25):
        menu = "<div class=m><p>Home</p><p>News</p></div>" if i % 9 else "<div class=m><p>Home</p></div>"
        foot = f"<div class=f><p>{rnd.choice(['one', 'two'])}</p></div>"
        pages.append(f"<html><body><div class=w>{menu}<div class=b><p>body {i}</p><p>{rnd.random()}</p></div>{foot}</div>")
    want = {p: t for p, t in brute_importance(pages).items() if t}
    df = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    counts = site_tree.style_counts(df)
    got = {x["path"]: set(x["texts"]) for r in site_tree.low_branches(site_tree.style_tree(counts), counts).collect() for x in r["low"]}
    assert got == want and want
    texts = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    assert texts == {i: site_tree.main_text(site_tree.parse(p), {k: frozenset(v) for k, v in want.items()}) for i, p in enumerate(pages)}
    # with the tree's say taken away the texts are others
    assert any(texts[i] != site_tree.main_text(site_tree.parse(p)) for i, p in enumerate(pages))


def test_bpe_against_library(odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for r in bpe.encode_decode(odd, path).join(odd.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).distinct(), F.expr("doc_id <=> k")).collect():
        ids = t.encode(r.t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path).count() == 0


def test_multiset_hash(odd, empty):
    one, two = multiset_hash.fingerprint("a b c\nd e"), multiset_hash.fingerprint("d e\na b c\n")
    assert one == two
    more = multiset_hash.add(one, multiset_hash.fingerprint("new line here"))
    assert more == multiset_hash.fingerprint("a b c\nnew line here\nd e")
    assert multiset_hash.subtract(more, multiset_hash.fingerprint("d e")) == multiset_hash.fingerprint("a b c\nnew line here")
    got = multiset_hash.compare_edits(odd).collect()
    assert len(got) == odd.count() and multiset_hash.compare_edits(empty).count() == 0
    whole = {(r.doc_id, r.text or "") for r in odd.collect()}
    prints = {(k, multiset_hash.fingerprint(t), len(t)) for k, t in whole}
    assert {(r.doc_id, r.fingerprint, r.n_chars) for r in got} == prints


def plain_likeness(a, b):
    """Likeness of two texts from lanes counted word by word."""
    def lanes(text):
        out = np.zeros(multiset_hash.LIKE)
        for p in text.encode().split(b"\n"):
            _, _, w = word_hashes(np.frombuffer(p + b"\n", dtype=np.uint8))
            for i in range(len(w)):
                second, third = (w[i + j] if i + j < len(w) else np.uint64(0) for j in (1, 2))
                with np.errstate(over="ignore"):
                    h = mix64(np.array([w[i] * np.uint64(3) + mix64(np.array([second + np.uint64(0x9E3779B97F4A7C15)]))[0] + third * np.uint64(0xC2B2AE3D27D4EB4F)]))[0]
                out[int(h >> np.uint64(57))] += 1 - 2 * int(h >> np.uint64(56) & np.uint64(1))
        return out
    if multiset_hash.fingerprint(a) == multiset_hash.fingerprint(b):
        return 1.0
    x, y = lanes(a), lanes(b)
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return float(np.clip((x * y).sum() / norm, 0, 1)) if norm else 0.0


def test_multiset_likeness_by_definition(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    rows = sorted([r for r in rows if len(r[1]) < 3000][:25], reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in multiset_hash.compare_edits(df).collect()}
    for (k, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = multiset_hash.edited(t, n)
        assert got[k].edited_fingerprint == multiset_hash.fingerprint(changed)
        assert got[k].near_edited == pytest.approx(plain_likeness(t, changed)) and got[k].near_next == pytest.approx(plain_likeness(t, n))


def test_multiset_likeness_of_long_repeats():
    a, b = (multiset_hash.from_text(multiset_hash.fingerprint("a b c " * n)) for n in (40000, 20000))
    assert multiset_hash.likeness_of(*(x[None] for x in (*a, *b)))[0] > 0.99


def test_multiset_edits(spark):
    docs = table(spark, SF, "documents")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    want = {k: hashlib.sha256(multiset_hash.edited(t, n).encode()).hexdigest() for (k, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True)}
    got = multiset_hash.compare_edits(docs).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.3


def test_rule_ensemble(spark, odd, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = rule_ensemble.fit(docs, labels)
    rows = rule_ensemble.score(docs, model).join(labels, "doc_id").filter(rule_ensemble.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["__predicted"] == r.quality for r in rows]) > 0.97
    scored = rule_ensemble.score(odd, model).collect()
    stats = rule_ensemble.statistics(F.coalesce(F.col("text"), F.lit("")))
    plain = odd.select(*[c.cast("double").alias(k) for k, c in stats.items()]).collect()
    want = model.score_rows({k: np.array([r[k] for r in plain]) for k in stats})
    assert np.allclose(sorted(r["__score"] for r in scored), sorted(want)) and all(r["__predicted"] == (r["__score"] >= 0.3) for r in scored)
    again = rule_ensemble.fit(docs.repartition(7), labels.repartition(3))
    assert again == model
    assert rule_ensemble.score(empty, model).count() == 0
    assert rule_ensemble.fit(docs, labels.limit(0)).rules == ()


def test_sharding(odd, empty):
    got = sharding.digests(odd, 4, bucket_bytes=2000).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    assert sorted(map(str, got)) == sorted(map(str, sharding.digests(odd.repartition(3), 4, bucket_bytes=2000).collect()))
    assert len(got) == odd.count() and sharding.digests(empty, 4).count() == 0
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert sorted(sharding.fisher_yates(50, [1, 2]).tolist()) == list(range(50))


def test_token_coder(spark, odd, empty):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([5]), rng.integers(0, 1 << 17, 5000), np.tile([1, 2, 3], 900)):
        data = token_coder.encode_ids(ids)
        assert (token_coder.decode_ids(data) == ids).all()
    data = token_coder.encode_ids(np.arange(9000) % 700)
    start, at = token_coder._Start.unpack(data)
    for place in (at // 2, len(data) - 9):  # in the head, and in the last block
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            token_coder.decode_ids(bytes(broken))
    blocks = token_coder.split_blocks(bytes(broken), at)  # the blocks before it are whole
    good = token_coder.decode_blocks(start, blocks[:-1])
    assert (np.concatenate(good) == np.arange(9000)[: sum(map(len, good))] % 700).all()
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_coder.read_tokens(spark, token_coder.write_tokens(odd, path), values=True).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (k, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.ids) == (k, start, ids)
        start += len(ids)
    assert token_coder.read_tokens(spark, token_coder.write_tokens(empty, path)).count() == 0


def test_token_coder_beats_order_0():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").slice(0, 300)["text"].to_pylist()
    ids = np.array([i for x in texts for i in [*t.encode(x or "", add_special_tokens=False).ids, 2]])
    share = np.bincount(ids)[ids] / len(ids)
    assert 8 * len(token_coder.encode_ids(ids)) < -np.log2(share).sum()


def test_word_tokenizer_against_library():
    rnd = random.Random(3)
    t = token_coder.WordTokenizer(queries.tokenizer_file("byte_bpe_50k.json"))
    texts = ["", "don't I'll we're 'tis ''s 's it's's", "\n\n a\n b \t c", "é ñ 日本語 १२३ ½ x²", "'", " 's", "'d've", "ab" * 100 + " " + "x" * 70, "   ", "a\u00a0\u2028 b", "<|endoftext|> a", "'s'll", "end  "]
    texts += ["".join(rnd.choice(" \n\t'stmdrevl1é.,\u3000A") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        data = [x.encode() for x in part]
        ids, n = t.encode_texts(b"".join(data), np.cumsum([len(x) for x in data]))
        want = [e.ids for e in t.library.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def brute_components(rows, n, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    comp = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {k: (len(sets[k]), comp[k]) for k in sets}


def test_partenum_signatures_and_bound():
    rng = np.random.default_rng(11)
    for percent in (80, 85):
        for size in [*range(1, 40), 300, 301, 2000]:
            for _ in range(4):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                gone = int(rng.integers(0, size * (100 - percent) // 100 + 1))
                new = np.unique(rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 1))).astype(np.uint64))
                b = np.unique(np.concatenate((a[gone:], new)))
                if jaccard_join.linked(a, b, percent):
                    assert jaccard_join.may_link(jaccard_join.parities(a), jaccard_join.parities(b), len(a) + len(b), percent)
                    assert len(a) == len(b) and (a == b).all() or np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)).size


def test_jaccard_join(spark, odd, empty):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, words=4, percent=85).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    # rows with one id and a null id: components by the texts themselves
    rows = [(i, r.text or "") for i, r in enumerate(odd.collect())]
    want = brute_components(rows, 5, 80)
    numbered = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in numbered} == want
    assert jaccard_join.classes(odd).count() == odd.count()
    base = rows[2][1]
    near = [(None, base + " x"), (None, base + " y"), (9, base), (12, base + " z"), (None, "other words that nobody else has at all")]
    got = jaccard_join.classes(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.component_id for r in got), key=str) == [9, 9, 9, 9, None]
    assert jaccard_join.classes(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 3").count() == 0 and kept.filter("doc_id is null").count() == 1


def test_mixing(odd, empty):
    got = mixing.mix(odd, fraction=1.0, max_epochs=2)
    assert got.columns == [*odd.columns, "mix_epoch"]
    assert mixing.mix(empty).count() == 0
    every = mixing.decide(odd, budget=1e9, max_epochs=2).collect()
    assert len(every) == odd.count() and all(r["__times"] == 2 for r in every)
    budget = 3000
    taken = mixing.epochs(mixing.decide(odd, budget=budget)).agg(F.sum("__tokens")).first()[0]
    assert taken <= budget


def test_pipeline_columns(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing_by_salted_leaves(odd, monkeypatch):
    want = sorted(map(str, mixing.decide(odd, fraction=0.6, max_epochs=3).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(map(str, mixing.decide(odd, fraction=0.6, max_epochs=3).collect())) == want


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert got.columns == docs.columns
            assert got.count() == 0 if docs is empty else got.count() > 0
    near = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    assert sum(r.doc_id in (2, 3) for r in near) == 2  # repeated rows of the least id stay, its copy goes
    assert corpus_pipeline.passages(spark, odd, SF).count() == odd.count()


def test_pipeline_against_plain_python(spark):
    """All stages after the classifier, over its rows, by brute force."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = rule_ensemble.fit(docs, labels)
    kept = {r.doc_id: r for r in rule_ensemble.score(docs, model).collect() if r["__predicted"] == 1}
    component = brute_components([(k, r.text or "") for k, r in kept.items()], 5, 80)
    kept = {k: r for k, r in kept.items() if component[k][1] == k}
    cut, seen = {}, {}
    for k in sorted(kept):
        data = (kept[k].text or "").encode()
        mark = np.zeros(len(data), dtype=bool)
        for j in range(len(data) - 49):
            if seen.setdefault(data[j : j + 50], k) != k:
                mark[j : j + 50] = True
        for on, off in zip(*(np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))) == s) for s in (1, -1)), strict=True):
            while on < off and data[on] & 0xC0 == 0x80:  # a character cut in two stays
                mark[on] = False
                on += 1
            while off > on and off < len(data) and data[off] & 0xC0 == 0x80:
                off -= 1
                mark[off] = False
        cut[k] = bytes(np.frombuffer(data, np.uint8)[~mark]).decode()
    rows = [(k, cut[k], kept[k].lang, kept[k].source, len(cut[k])) for k in cut]
    mixed = mixing.mix(spark.createDataFrame(rows, docs.schema), **queries.MIX).collect()
    t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    want = []
    for r in mixed:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want) and got


def test_mixed_buckets_make_each_pair():
    rng = np.random.default_rng(3)
    bits = [rng.integers(0, 256, 8, dtype=np.uint8).tobytes() for _ in range(40)]
    buckets = {int(k): sorted(set(rng.choice(40, 12).tolist())) for k in rng.integers(-(2**62), 2**62, 60)}
    for spread, blocks in ((1, 1), (40, 1), (1, 3), (40, 3)):  # one family of many labels, and all apart; one block, and several
        rows = []
        for k in sorted(buckets):
            for u in range(blocks):
                for v in range(u, blocks):
                    for node in buckets[k]:
                        if node % blocks in (u, v):
                            heads = sorted(b for b, nodes in buckets.items() if node in nodes)[: jaccard_join.HEADS]
                            rows.append((k, u, v, node, node % (spread + 1), 20, bits[node], heads, node % blocks))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "u", "v", "node", "label", "n", "bits", "heads", "block"])
        got = [p for b in jaccard_join._mixed(10)([batch]) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        want = {(a, b) for nodes in buckets.values() for a in nodes for b in nodes if a < b and a % (spread + 1) != b % (spread + 1) and jaccard_join.may_link(bits[a], bits[b], 40, 10)}
        assert want and set(got) == want and len(got) < 1.2 * len(want)
