"""Language identification against a plain version, with every odd case."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docstrata.llm.langid import EVIDENCE, FEATURES, KAPPA, SMOOTH, identify

WORDS = {"en": "the of and is not that with for from this", "de": "der die das und ist nicht mit für über größe", "fr": "le la et les des une que est pas très"}


def trigrams(text):
    folded = "".join(c if ord(c) > 0xBF or "a" <= c <= "z" else " " for c in f" {text.lower()} ")
    folded = re.sub(" +", " ", folded)
    return Counter((ord(a) * 7919 + ord(b) * 104729 + ord(c) * 1299709) % FEATURES for a, b, c in zip(folded, folded[1:], folded[2:], strict=False) if b != " ")


def normal(logs):
    top = max(logs)
    exps = [math.exp(x - top) for x in logs]
    return [x / sum(exps) for x in exps]


def plain(pages, labelled):
    sums = defaultdict(Counter)
    for text, lang in labelled:
        if text is not None and lang is not None:
            sums[lang] += trigrams(text)
    langs = sorted(sums)
    k = len(langs)
    logs = {x: [math.log((sums[x][i] + SMOOTH) / (sum(sums[x].values()) + SMOOTH * FEATURES)) for i in range(FEATURES)] for x in langs}
    rows = []
    for page, url, source in pages:
        source = source or ""
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style|head|nav)\b.*?</\1\s*>", " ", source)
        counts = trigrams(html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare)))
        n = sum(counts.values())
        ll = [sum(c * logs[x][i] for i, c in counts.items()) * min(1, EVIDENCE / max(n, 1)) for x in langs]
        ll = [x - max(ll) for x in ll]
        m = re.search(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        said = re.search(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", source)
        name = re.search(r"([^.]+\.[^.]+)$", host)
        rows.append((page, host, name[1] if name else "", host.rsplit(".", 1)[-1], said[1].lower() if said else "", ll, normal(ll)))
    tally = lambda pick: {key: [sum(r[6][i] for r in rows if pick(r) == key) for i in range(k)] for key in {pick(r) for r in rows}}
    smoothed = lambda own, above: [(x + KAPPA * a) / (sum(own) + KAPPA) for x, a in zip(own, above, strict=True)]
    total = [sum(r[6][i] for r in rows) for i in range(k)]
    world = [(x + 1) / (sum(total) + k) for x in total]
    suffixes = {s: smoothed(v, world) for s, v in tally(lambda r: r[3]).items()}
    names = {key: smoothed(v, suffixes[key[1]]) for key, v in tally(lambda r: (r[2], r[3])).items()}
    hosts, declared = tally(lambda r: r[1]), tally(lambda r: r[4])
    out = []
    for page, host, name, suffix, said, ll, p in rows:
        prior = smoothed([max(x - y, 0) for x, y in zip(hosts[host], p, strict=True)], names[name, suffix])
        says = [0.0] * k if said == "" else [math.log((x + 0.1) / (t + 1)) for x, t in zip(declared[said], total, strict=True)]
        post = normal([a + math.log(b) + c for a, b, c in zip(ll, prior, says, strict=True)])
        silent = max(ll) == min(ll) and k > 1
        out.append((page, langs[post.index(max(post))], max(post), None if silent else langs[ll.index(max(ll))], said, host, suffix))
    return out


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(w.split()) for _ in range(30)), x) for x, w in WORDS.items() for _ in range(5)]
    return [*rows, rows[0], (None, "en"), ("x", None), ("", "de")]


def test_op1_against_a_plain_version(spark, labelled):
    rng = random.Random(2)
    pages = []
    for k in range(80):
        x = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(WORDS[x].split()) for _ in range(rng.choice([0, 1, 3, 40])))
        text = text.replace("ü", rng.choice(["ü", "&uuml;", "&#252;"]))
        lang = rng.choice(["", f" lang='{x}'", f' LANG="{x.upper()}-x"', " lang=zz"])
        host = rng.choice(["a.example.de", "b.example.de", "example.com", "www.big.fr", "one"])
        pages.append((k, rng.choice([f"https://{host}/p?q", f"http://u@{host}:80"]), f"<html{lang}><head><title>the the</title></head><!-- le --><p>{text}</p><script>and</script>"))
    pages += [pages[3], pages[3], (None, None, None), (99, "", ""), (100, "not an address", "<p>12 34</p>"), (101, "http://long.de/", "<p>" + "der und " * 20_000)]
    frame = spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id long, url string, html string, host string, p double").repartition(3)
    docs = spark.createDataFrame([(*r, 1) for r in labelled], "text string, lang string, v int")
    spell = lambda r: (str(r[0]), r[1], f"{r[2]:.9f}", *map(str, r[3:]))
    assert Counter(spell(tuple(r)) for r in identify(frame, docs).collect()) == Counter(map(spell, plain(pages, labelled)))


def test_op1_without_labels_and_with_ties(spark, labelled):
    frame = spark.createDataFrame([(1, "http://a.b/", "<p>the</p>"), (1, "http://a.b/", "<p>the</p>")], "page_id long, url string, html string")
    none = spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string")
    assert [(r.lang, r.confidence) for r in identify(frame, none).collect()] == [(None, 0.0)] * 2
    tied = spark.createDataFrame([("the of", "xx"), ("the of", "aa")], "text string, lang string")
    assert [(r.lang, round(r.confidence, 9)) for r in identify(frame, tied).collect()] == [("aa", 0.5)] * 2
