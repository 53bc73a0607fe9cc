"""Each training-data operator against plain Python on small rows, with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.llm import components, embedding_dedup, exact_dedup, html_text, jaccard_join, mixing, pii, quality, sentencepiece_bpe, token_counts, url_filter
from veristrata.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, run string, digest string, node long, keep_id long"
ODD = ["", " ", "  a", "a  b ", "\n\n x\ty", "▁a▁ b", "日本語 🎉x", "a b", "<s> </s> <0x41>", "a<|endoftext|>b", " " * 50 + "q", "x" * 3000, "it's 12's", "word " * 400, "a\u0001b", "a.b(c)d_e1f,2x'y's"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", 3, "r", "d", 1, 2) for i, t in texts], DOCS)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(n))


# ------------------------------------------------------------------ 1
def base_spans(text):
    out = []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PII = ["a@b.c%d@e.f", "x1.2.3.4.5 1.2.3.4", "é🎉 +1 (234) 555-8958.", "4349000490986231", "4349 0004 9098 6231 4349-0004-9098-6231", "+12345678901 +1234567890123456 +1..2", "256.1.1.1 00255.1.1.1 1.2.3.4.5.6.7.8",
       "@a.b a@b a@b.c.d. %@x.y", "9" * 30000, "a" * 50000 + "@x.y", "1.2.3 4.5.6.7", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", " ", "", None]


def test_base_spans(spark):
    rows = [*enumerate(PII), (0, PII[0]), (None, PII[0])]
    found = pii.find_pii(table(spark, rows)).select("doc_id", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.b) for r in found) == sorted((str(i), base_spans(t or "")) for i, t in rows)
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in found)


def test_trusted_contexts_add_spans(spark):
    r = random.Random(1)
    rows = [(k, f"please note customer card number {''.join(r.choice('0123456789') for _ in range(16))} as given, the old 12345678") for k in range(200)]
    found = pii.find_pii(table(spark, rows)).select(F.size("base").alias("b"), F.size("spans").alias("s")).collect()
    assert sum(x.b for x in found) < 60 and all(x.s == 1 for x in found)


def test_varied_contexts_are_trusted(spark):
    r = random.Random(4)

    def card(ok):
        head = "".join(r.choice("0123456789") for _ in range(15))
        return next(c for c in (head + d for d in "0123456789") if bool(base_spans(c)) == ok)

    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(k, f"given under {names[k % 100]} account {card(k < 2000)} then") for k in range(2100)] + [(5000, f"seen at rare place {card(False)}")]
    found = pii.find_pii(table(spark, rows)).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("s")).collect()
    assert {r.doc_id for r in found if r.b} == set(range(2000)) and {r.doc_id for r in found if r.s} == set(range(2100))


def test_pii_empty(spark):
    assert pii.find_pii(table(spark, [])).collect() == []


# ------------------------------------------------------------------ 2 and 10
def test_sentencepiece_equals_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = [*enumerate(ODD), (99, None), (0, ODD[0]), (50, words(1, 500))]
    got = sentencepiece_bpe.sentencepiece_roundtrip(table(spark, rows), tokenizer_path("piece_bpe_32k.model"), keep=True).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        ids = lib.encode(text[r.doc_id] or "", add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("token", ["\x00\n", "\x00.b", "ab", "", "\x00▁a▁b"])
def test_every_new_token_is_checked(token):
    model = sentencepiece_bpe.MergeModel(tokenizer_path("piece_bpe_32k.model"))
    cache = sentencepiece_bpe.SegmentCache(model)
    ids = model.encode_segment(model.symbols_of(token))
    text = model.decode(ids, strip=False)
    cache.check([token], [ids], [text])
    for wrong in (([*ids, 5], text), (ids, text + "x")):
        with pytest.raises(ValueError, match="differs from the library"):
            cache.check([token], [wrong[0]], [wrong[1]])


def test_agendas_agree():
    model = sentencepiece_bpe.MergeModel(tokenizer_path("piece_bpe_32k.model"))
    texts = ["▁" + words(k, 1 + k % 6).replace(" ", "▁") + "é日"[: k % 3] for k in range(300)]
    assert model.encode_segments(texts) == [model.encode_segment(t) for t in texts]


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [*enumerate(ODD), (99, None), (0, ODD[0]), (50, words(1, 900))]
    got = token_counts.token_counts(table(spark, rows), tokenizer_path("byte_bpe_50k.json")).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = text[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert token_counts.token_counts(table(spark, []), tokenizer_path("byte_bpe_50k.json")).collect() == []


# ------------------------------------------------------------------ 3
@pytest.mark.parametrize("memtable_rows", [3, 50_000])
def test_exact_dedup(spark, monkeypatch, memtable_rows):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", memtable_rows)
    rows = [(k, ["x", "y", "", None, "z" * 100, words(k, 5)][k % 6]) for k in range(60)] + [(7, "y"), (None, "x")]
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        members = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        assert (r.keep_id, r.group_size) == (max(x for x in members if x is not None), len(members))
    kept = exact_dedup.drop_copies(table(spark, rows)).collect()
    assert sorted(r.text or "" for r in kept) == sorted(groups) and kept[0].asDict().keys() == table(spark, rows).first().asDict().keys()
    assert exact_dedup.exact_dedup(table(spark, [])).collect() == []


def test_copies_are_dropped_by_row(spark):
    rows = [(None, "x"), (None, "unique"), (5, "x"), (5, "other"), (5, "x"), (7, "y"), (7, "z"), (8, "z"), (None, "n"), (None, "n"), (None, "m"), (None, None), (None, "")]
    kept = exact_dedup.drop_copies(table(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("5", "other"), ("5", "x"), ("7", "y"), ("8", "z"), ("None", ""), ("None", "m"), ("None", "n"), ("None", "unique")]


def test_colliding_digests_are_split(spark, monkeypatch):
    class One:
        def __init__(self, text):
            self.text = text

        def digest(self):
            return b"0" * 32

    # tasks run in other processes, so the memtable is tried by itself
    monkeypatch.setattr(exact_dedup.hashlib, "sha256", One)
    memtable = exact_dedup.Memtable(True)
    for k, t in enumerate([b"a", b"b", b"a"]):
        memtable.put(k, t)
    rows = memtable.flush(0).to_pylist()
    assert sorted((r["variant"], r["doc_id"], r["keep"], r["n"]) for r in rows) == [(0, 0, 2, 2), (0, 2, 2, 2), (1, 1, 1, 1)]


# ------------------------------------------------------------------ 4
PAGES = [
    ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=\"ad\">Buy this now, please.</div><article><h1>Head &amp; line</h1><p><b>Lead<br>text, yes.<p>Second  paragraph,\n here.</p><p>Short.</p></article><footer>&copy; me</footer></body></html>", "Head & line\n\nLead text, yes.\n\nSecond paragraph, here.\n\nShort."),
    ("<div class='sidebar'>x</div><div id=main><h2>T</h2><p>Hello, this is the article text, with marks. <a href=x>Link</a> more.</p><ul><li>one<li>two</ul></div><div class=comments><p>nice post, really. I agree, yes.</p></div><form>f</form>", "T\n\nHello, this is the article text, with marks. Link more.\n\none\n\ntwo"),
    ("<body><header><h1>Site</h1></header><main><article><p>Body text, ok.</p><section class='comment-list'><p>c, d.</p></section></article></main></body>", "Body text, ok."),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<p>a<p>b", "a\n\nb"), ("<!-- c --><script>x</script>", ""),
]


def test_html(spark):
    rows = [(k, "u", h, "extra") for k, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "extra")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (PAGES[r.page_id][1], len(PAGES[r.page_id][1]))


def test_html_head_without_end():
    page, text = PAGES[0]
    for left_out in ("</head>", "</title>", "</head><body>"):
        assert html_text.main_text(page.replace(left_out, "")) == text
    assert html_text.main_text(page.replace("</head>", "").replace("</title>", "")) == text
    assert html_text.main_text("<head><meta charset=utf-8><title>a <p> b</title><noscript><p>Turn it on.</p></noscript><p>Text, yes.") == "Text, yes."
    assert html_text.main_text("<head><title>t</title>Bare text.<script>x</script>") == "Bare text."
    assert html_text.main_text("<head><title>t<p>Text, yes.") == "Text, yes."


def test_html_lists_of_links():
    text = "<p>The text of this page, with marks. It says more, and more.</p>"
    links = "<ul>" + "".join(f"<li><a href=x>Source {k}</a></li>" for k in range(4)) + "</ul>"
    sources = "\n\n".join(f"Source {k}" for k in range(4))
    for tag in ("article", "main class='x'"):
        assert html_text.main_text(f"<body><{tag}>{text}{links}</{tag.split()[0]}>{links}</body>") == f"{text[3:-4]}\n\n{sources}"
    assert html_text.main_text(f"<body><div id=x>{text}{links}</div></body>") == text[3:-4]


# ------------------------------------------------------------------ 5
def test_quality_learns_and_ignores_ids(spark):
    rows = [(k, (words(k, 30) + ".") if k % 3 else " | ".join([words(k % 7, 1)] * 30)) for k in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0, 0) for k in range(400)] + [(900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table(spark, rows), labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert min(r.score for r in held if r.doc_id % 3) > max(r.score for r in held if r.doc_id % 3 == 0)
    kept = quality.keep_good(table(spark, rows), labels)
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality_scores(table(spark, [(1, "a")]), none).collect()] == [0.5]


# ------------------------------------------------------------------ 6
def test_url_rules_and_model(spark):
    urls = ["http://a.com/x?q", "HTTP://B.Example.COM/en/1", "http://www.example.com/en/", "https://x.net/es/1#f", "https://x.net/fr/", "https://notnet/es/", "x", None, "", "http://com", "http://q.org/a"]
    urls += [f"http://good{k}.com/story/{k}" for k in range(40)] + [f"http://bad{k}.net/es/deal/{k}" for k in range(40)] + ["http://bad7.org/deal/7", "http://good9.org/story/3"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_verdicts(df).collect()}
    assert len(got) == len(urls)
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(11)] == [("a.com", "/x", "com/"), ("b.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("x.net", "/es/1", "net/es/"), ("x.net", "/fr/", "net/fr/"), ("notnet", "/es/", None), ("", "", None), ("", "", None), ("", "", None), ("com", "", None), ("q.org", "/a", None)]
    assert [got[k].verdict for k in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[len(urls) - 2].verdict, got[len(urls) - 1].verdict) == ("block", "allow")
    assert all(r.verdict in ("allow", "block") for r in got.values())


# ------------------------------------------------------------------ 7
def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(k, (centres[k % 30] + rng.normal(size=24) * 0.12 * (k % 4)).tolist(), 0) for k in range(240)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, None, 0), (503, [0.0] * 24, 0), (504, [None] * 24, 0), (505, [float("nan")] * 24, 0), (506, [1.0] * 7, 0), (507, [], 0)]
    for tile in (512, 8):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
        ok = [(i, np.float32(v).astype(float)) for i, v, _ in rows if v and v[0] is not None and len(v) == 24 and np.isfinite(v).all() and any(v)]
        x = np.array([v / np.linalg.norm(v) for _, v in ok])
        linked = x @ x.T >= 0.95
        np.fill_diagonal(linked, False)
        least = list(range(len(ok)))
        for _ in ok:
            least = [min([least[k], *[least[j] for j in np.flatnonzero(linked[k])]]) for k in range(len(ok))]
        for k, (i, _) in enumerate(ok):
            assert (got[i].n_links, got[i].component_id) == (linked[k].sum(), ok[least[k]][0])
        for i in range(502, 508):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embeddings_of_one_id(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 16))
    rows = [([None, 3, k][k % 3], (centres[k % 9 if k % 5 else 0] + rng.normal(size=16) * 0.1 * (k % 4)).tolist()) for k in range(90)]
    x = np.array([np.float32(v).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    ids = [-1 if i is None else i for i, _ in rows]
    least = list(ids)
    for _ in rows:
        least = [min(least[j] for j in np.flatnonzero(linked[k])) for k in range(len(rows))]
    want = sorted((i, int(linked[k].sum()) - 1, c) for k, (i, c) in enumerate(zip(ids, least, strict=True)))
    for tile in (512, 8):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == want


# ------------------------------------------------------------------ 8
def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            s, t = sets[i], sets[j]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("long_list", [32, 3])
def test_jaccard_components(spark, long_list):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 60))] for _ in range(10)]
    common = [r.choice(vocabulary) for _ in range(30)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (6, "ÄB c"), (7, "äB c")]
    for k in range(300):
        w = list(r.choice(base)) if r.random() < 0.8 else [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocabulary)
        w = w + common if r.random() < 0.2 else common + w[:3] if r.random() < 0.1 else w
        rows.append((10 + k, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(table(spark, rows).repartition(4), long_list=long_list, tile=20).collect()}
    assert got == brute_components(rows)
    kept = jaccard_join.drop_similar(table(spark, rows))
    assert {x.doc_id for x in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_components(table(spark, [])).collect() == []
    got = jaccard_join.jaccard_components(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert [(x.doc_id, x.n_shingles) for x in sorted(got, key=str)] == [(4, 2), (4, 2), (None, 2)]


def test_near_copies_are_dropped_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a), (3, b), (5, b + " q"), (None, c), (None, c + " q"), (None, d), (9, d + " q"), (8, d + " r"), (7, "alone one"), (7, "alone one"), (6, a + " r"), (5, a + " s"), (1, " "), (1, " "), (None, None), (None, "")]
    kept = jaccard_join.drop_similar(table(spark, rows).repartition(3)).collect()
    got = [(r.doc_id, r.text) for r in kept]
    for part, ids in ((a, [5]), (b, [3]), (c, [None]), (d, [None]), ("alone one", [7])):
        assert [i for i, t in got if (t or "").startswith(part)] == ids
    assert len(got) == 9 and kept[0].asDict().keys() == table(spark, rows).first().asDict().keys()


def test_merging_lists():
    lists = [np.array([[1, 2], [5, 1]]), np.array([[5, 3], [9, 1]]), np.zeros((0, 2), int)]
    assert list(jaccard_join.merge_lists(lists)) == [(1, 2), (5, 4), (9, 1)]


def test_tiles_link_components():
    blob = lambda *x: np.array(x, np.uint64).tobytes()
    rows = [{"side": s, "node": n, "c": c, "blob": b} for s, n, c, b in [(0, 1, 1, blob(1, 2, 3, 4)), (0, 2, 1, blob(1, 2, 3, 9)), (0, 3, 3, blob(7, 8)), (1, 4, 4, blob(1, 2, 3, 4)), (1, 5, 5, blob(7, 9))]]
    got = [r for batch in jaccard_join.tile_links(rows, 75) for r in batch.to_pylist()]
    assert got == [{"a": 4, "b": 1}]


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(-5, -9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 180)) and got[-5] == -9


# ------------------------------------------------------------------ 9
def fill(parts, budget):
    """Water filling of (weight, capacity) by bisection."""
    if sum(c for w, c in parts if w > 0) <= budget:
        return [c if w > 0 else 0 for w, c in parts]
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for w, c in parts) < budget else (lo, mid)
    return [min(c, lo * w) for w, c in parts]


def test_mixing_budgets_and_copies(spark):
    r = random.Random(2)
    rows = [(k, words(k, r.randint(0, 30)), r.choice(["en", "de", "fr", None]), f"src{r.choice([1, 1, 1, 2, 7, 9, 19])}", 1, "x", "y", 1, 1) for k in range(600)] + [(9000, None, "en", None, 0, "", "", 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    plan = [x.asDict() for x in mixing.plan(df, rows_per_bucket=40).collect()]
    assert len(plan) == len(rows)
    tree = {}
    for p in plan:
        tree.setdefault(p["domain"], {}).setdefault(p["lang"], {}).setdefault(p["source"], []).append(p)
    tokens = lambda n: sum(p["n_tokens"] for p in n) if isinstance(n, list) else sum(map(tokens, n.values()))
    capacity = lambda n: 2.0 * tokens(n)
    top = fill([(mixing.DOMAIN_WEIGHTS.get(k, 1.0), capacity(v)) for k, v in tree.items()], 0.6 * tokens(tree))
    for (_, langs), b in zip(tree.items(), top, strict=True):
        for (_, sources), c in zip(langs.items(), fill([(mixing.LANG_WEIGHTS.get(k, 1.0), capacity(v)) for k, v in langs.items()], b), strict=True):
            for (_, leaf), e in zip(sources.items(), fill([(1.0, capacity(v)) for v in sources.values()], c), strict=True):
                assert abs(leaf[0]["leaf_budget"] - e) <= 1.01
                want = {}
                for epoch in (1, 2):
                    left = leaf[0]["leaf_budget"] - (epoch - 1) * tokens(leaf)
                    run = 0
                    for p in sorted(leaf, key=lambda p: hashlib.md5(f"mix-1:{epoch}:{p['doc_id']}".encode()).hexdigest()):
                        run += p["n_tokens"]
                        want[p["doc_id"]] = want.get(p["doc_id"], 0) + int(run <= left and left > 0)
                assert {p["doc_id"]: p["copies"] for p in leaf} == want
    mixed = mixing.mix(df, rows_per_bucket=40)
    assert mixed.columns == df.columns and mixed.count() == sum(p["copies"] for p in plan)
    assert mixing.plan(spark.createDataFrame([], DOCS)).collect() == []
