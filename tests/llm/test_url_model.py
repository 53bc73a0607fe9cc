"""The character models of the URL filter against plain dictionaries."""

import math
import random
import zlib
from collections import Counter

from veristrata.llm import url_filter as U

SCHEMA = "page_id long, url string, host string, llr double, _salt int"


def plain(urls):
    """{url: score} by counting every context of 0 to ORDER characters."""
    def parts(url):
        rest = (url or "").partition("://")
        if not rest[1]:
            return "", ""
        cut = min([rest[2].find(c) for c in "/?#" if c in rest[2]], default=len(rest[2]))
        return rest[2][:cut].lower(), rest[2][cut:].split("?")[0].split("#")[0] if rest[2][cut : cut + 1] == "/" else ""

    def verdict(host, path):
        best = None
        for rule, said in U.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = (rule, said)
        return best and best[1]

    whole = lambda kind, s: U.PAD * (U.ORDER - 1) + kind + s + U.STOP
    grams = lambda kind, s: [whole(kind, s)[k : k + U.ORDER + 1] for k in range(len(s) + 1)]
    counts, strings = {"allow": Counter(), "block": Counter()}, set()
    for url in urls:
        pair = parts(url)
        said = verdict(*pair)
        for kind, s in zip("\x04\x05", pair, strict=True):
            strings.add((kind, s))
            if said and zlib.crc32((url or "").encode()) % U.FOLDS:
                counts[said].update(grams(kind, s))
    every = {g for kind, s in strings for g in grams(kind, s)}
    symbols = len({g[-1] for g in every}) + 1
    tables = {}
    for said, held in counts.items():
        for k in range(U.ORDER + 1):
            t = tables[said, k] = Counter()
            for g, n in held.items():
                t[g[U.ORDER - k :]] += n

    def p(said, g):
        value = (tables[said, 0][g[-1]] + 1) / (sum(tables[said, 0].values()) + symbols)
        for k in range(1, U.ORDER + 1):
            tail = g[U.ORDER - k :]
            context = sum(n for x, n in tables[said, k].items() if x[:-1] == tail[:-1])
            value = (tables[said, k][tail] + U.SMOOTH * value) / (context + U.SMOOTH)
        return value

    llr = {g: math.log(p("allow", g)) - math.log(p("block", g)) for g in every}
    out = {}
    for url in urls:
        host, path = parts(url)
        out[url] = sum(llr[g] for kind, s in (("\x04", host), ("\x05", path)) for g in grams(kind, s)) / (len(host) + len(path) + 2)
    return out


def test_scores_against_plain_models(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    urls = [f"http://{word()}.{r.choice(['com', 'net', 'org', 'example.com'])}/{r.choice(['es', 'en', 'fr', word()])}/{word()}" for _ in range(60)] + [None, "", "x", "ftp://a.com?q", "http://" + "b" * 3000 + ".com/x"]
    urls += urls[:5]
    df = spark.createDataFrame([(k, u, "h", 0.5, 1) for k, u in enumerate(urls)], SCHEMA)
    want = plain(urls)
    got = U.url_verdicts(df).collect()
    assert len(got) == len(urls)
    for x in got:
        assert abs(x.score - want[urls[x.page_id]]) < 1e-6
    assert U.url_verdicts(df.limit(0)).collect() == []
