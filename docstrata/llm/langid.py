"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a page are multiplied: the likelihood of its text under a
letter-trigram model of each language, the language its markup declares, the suffix of its
address, and its host. What a declaration is worth is learned from how often it goes with
each language over all pages. Suffix, registered name and host give a prior that is smoothed
from the top: each level starts from the one above as from KAPPA pages of it. All counts are
grouped sums of text posteriors over all pages, combined where the rows are, so a host that
holds a third of the pages costs no more than others.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import materialize, text_of
from docstrata.llm.tokenize import as_points, blocks, slices

FEATURES = 4096
KAPPA = 4.0  # pages that a level of the prior counts as
EVIDENCE = 60.0  # trigrams of independent evidence that a long text counts as
SMOOTH = 0.5
MAX_LANGUAGES = 500  # bound of what the model broadcasts


def page_text(source: Column) -> Column:
    """The visible text of a page, entities as written: no comments, scripts, styles, head or tags."""
    bare = F.regexp_replace(source, r"(?is)<!--.*?-->|<(script|style|head|nav)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    return F.regexp_replace(bare, r"\s+", " ")


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Hashed counts of the letter trigrams of each text, runs of other characters as one blank."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for lo, hi in blocks(texts):
        points, bounds = as_points([f" {t.lower()} " for t in texts[lo:hi]])
        letter = (points > 0xBF) | ((points >= 97) & (points <= 122))
        points = np.where(letter, points, 32).astype(np.int64)
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
        keep = np.concatenate(([True], letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])))
        points, owner = points[keep], owner[keep]
        if len(points) < 3:
            continue
        hashed = (points[:-2] * 7_919 + points[1:-1] * 104_729 + points[2:] * 1_299_709) % FEATURES
        inside = (owner[:-2] == owner[2:]) & (points[1:-1] != 32)
        flat = owner[:-2][inside] * FEATURES + hashed[inside]
        out[lo:hi] += np.bincount(flat, minlength=(hi - lo) * FEATURES).reshape(hi - lo, FEATURES)
    return out


def counts_of_texts(texts: list[str]) -> np.ndarray:
    """trigram_counts, long texts in slices."""
    if max(map(len, texts), default=0) <= 10**6:
        return trigram_counts(texts)
    return np.array([trigram_counts(slices(t)).sum(axis=0) for t in texts])


def fit_text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) from all labelled rows (text, lang).

    Sums of counts are made where the rows are; FEATURES numbers a language are collected.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for lo in range(0, len(langs), 1000):
                texts = batch.column("text").slice(lo, 1000).to_pylist()
                rows = counts_of_texts(texts)
                for lang in set(langs[lo : lo + 1000].tolist()):
                    sums[lang] = sums.get(lang, 0) + rows[langs[lo : lo + 1000] == lang].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * FEATURES), pa.array(np.arange(FEATURES, dtype=np.int32)), pa.array(v)], names=["lang", "i", "v"])

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    fitted = rows.mapInArrow(count, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for row in fitted.toLocalIterator():
        found.setdefault(row["lang"], np.zeros(FEATURES))[row["i"]] = row["v"]
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} labels: the text model goes to every task, {FEATURES} numbers a label")
    langs = sorted(found)
    table = np.array([found[x] for x in langs]).reshape(len(langs), FEATURES) + SMOOTH
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """pages (page_id, host, name, suffix, declared, text) with ll, the log-likelihoods, instead of the text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                counts = counts_of_texts([html.unescape(t) for t in part.column("text").to_pylist()])
                n = counts.sum(axis=1, keepdims=True)
                ll = (counts @ model.T) * np.minimum(1, EVIDENCE / np.maximum(n, 1))
                ll -= ll.max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "host", "name", "suffix", "declared")), pa.array(list(ll.astype(np.float64)), pa.list_(pa.float64()))],
                    names=["page_id", "host", "name", "suffix", "declared", "ll"],
                )

    return pages.mapInArrow(score, "page_id long, host string, name string, suffix string, declared string, ll array<double>")


def _normal(logs: Column) -> Column:
    """exp and divide by the sum."""
    exps = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host and suffix for each row of pages.

    pages has (page_id, url, html), labelled (text, lang). lang is the most probable language
    given all evidence, ties going to the first in alphabetical order; confidence its
    probability; text_lang the language by text alone, null for a page without letters. A
    null url has the empty host; null or missing declarations and texts carry no evidence. A
    page's own text is left out of the prior of its host. Repeated rows are counted each; a
    null page_id is returned as null; pages and labelled texts of any length count whole.
    Without labelled rows lang is null and confidence 0. Other columns are not read; an empty
    table of pages gives an empty result.
    """
    langs, model = fit_text_model(labelled)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.col("html"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("name"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        F.coalesce(declared, F.lit("")).alias("declared"), page_text(text_of("html")).alias("text"),
    )
    if not langs:
        empty = F.lit(None).cast("string")
        return parts.select("page_id", empty.alias("lang"), F.lit(0.0).alias("confidence"), empty.alias("text_lang"), "declared", "host", "suffix")
    k = len(langs)
    scored = _text_evidence(parts, langs, model).withColumn("p", _normal(F.col("ll")))
    scored = materialize(scored, "evidence")
    soft = [F.sum(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(k)]
    counts = [F.col(f"c{i}") for i in range(k)]
    hosts = materialize(scored.groupBy("host", "name", "suffix").agg(*soft), "hosts")
    tally = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]
    whole = hosts.agg(*tally).first()
    total = [whole[i] or 0.0 for i in range(k)]
    world = [(x + 1.0) / (sum(total) + k) for x in total]

    def smoothed(own: Column, above) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.transform(own, lambda x, i: (x + KAPPA * F.get(above, i)) / (n + KAPPA))

    suffixes = hosts.groupBy("suffix").agg(*tally).select("suffix", smoothed(F.array(*counts), F.array(*map(F.lit, world))).alias("above"))
    names = hosts.groupBy("name", "suffix").agg(*tally).join(suffixes, "suffix").select("name", "suffix", smoothed(F.array(*counts), F.col("above")).alias("above"))
    priors = materialize(hosts.join(names, ["name", "suffix"]).select("host", F.array(*counts).alias("own"), "above"), "priors")
    said = scored.groupBy("declared").agg(*soft).select("declared", F.transform(F.array(*counts), lambda x, i: F.log((x + 0.1) / (F.get(F.array(*map(F.lit, total)), i) + 1.0))).alias("says"))
    said = materialize(said.withColumn("says", F.when(F.col("declared") == "", F.array(*[F.lit(0.0)] * k)).otherwise(F.col("says"))), "said")

    joined = scored.join(priors, "host").join(said, "declared")
    others = F.transform("own", lambda x, i: F.greatest(x - F.get("p", i), F.lit(0.0)))
    fused = joined.withColumn("prior", smoothed(others, F.col("above")))
    fused = fused.withColumn("post", _normal(F.transform("ll", lambda x, i: x + F.log(F.get("prior", i)) + F.get("says", i))))
    names_of = F.array(*map(F.lit, langs))
    best = lambda c: F.get(names_of, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    silent = F.array_max("ll") == F.array_min("ll")
    return fused.select(
        "page_id", best(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"),
        F.when(~silent | (F.lit(k) == 1), best(F.col("ll"))).alias("text_lang"), "declared", "host", "suffix",
    )
