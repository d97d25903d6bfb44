"""Quality classifier: hierarchical empirical Bayes over document, host and path.

Evidence of a document: two logistic models over hashed words and a dozen shape measures, one for low quality and one for
toxic text, fitted on a bounded sample of labelled documents (SAMPLE rows, those whose id has the least hash). Evidence of
its site: over all documents, the models' probabilities are summed by path (source and language), paths are summed by host (source) and
hosts over the whole corpus. A host's rate is shrunk toward the global rate, and a path's toward its host's, each with a
strength fitted to how much the rates of its level differ (moments of a beta-binomial law), so a site with few documents
has its parent's rate. A document's final log odds are its own plus what its path's log odds differ from the global ones.

Sums go through partial aggregation, so a host with a third of the rows is a row for each task. The site table is joined to
the scored documents as a plain table: Spark broadcasts it only below its size threshold and splits a hot site otherwise.

Nulls: a null text is empty and is scored so; null source or language are sites of their own; null labels and ids take no
part in fitting. Empty tables give empty results; texts of any length are scored whole. Of more labelled rows than the sample holds, those of the least
hashes of their ids are taken; rows with one id have one hash, and which of them come last in the sample is not defined. Without labels the models say nothing (probability 0.5 for both kinds, and every row is kept). Repeated
rows are scored alike. Extra columns pass through.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, utf8, written
from .words import lowered, word_hashes, word_spans

#: Labelled rows to fit on, bits of a word's feature number, and bytes scored at once.
SAMPLE, BITS, AT_ONCE = 8000, 20, 2 << 20
SHAPES = 14
#: A word counts in a model if at least so many sampled documents hold it and its rates in the two classes differ by so many standard errors.
HELD, ERRORS = 4, 4.5
_KIND = np.zeros((6, 256), dtype=np.float32)
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, 128:] = 1
_KIND[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = 1
_KIND[4, [10]] = 1
_KIND[5, [b for b in range(128) if chr(b) in ".,"]] = 1
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts data[at[i]:at[i+1]]: text numbers and feature numbers of their distinct words, and the shape measures."""
    n = len(at) - 1
    low = lowered(data)
    starts, ends, first = word_spans(low, at)
    text = np.repeat(np.arange(n), np.diff(first))
    h = word_hashes(low, starts, ends)
    bare = [starts.copy(), ends.copy()]  # words without the marks around them
    for _ in range(4):
        bare[1] -= (bare[1] > bare[0] + 1) & _MARK[low[bare[1] - 1]]
        bare[0] += (bare[1] > bare[0] + 1) & _MARK[low[bare[0]]]
    hb = word_hashes(low, *bare)
    pair = np.unique(text.astype(np.int64) << BITS | (hb >> np.uint64(64 - BITS)).astype(np.int64))
    words = np.maximum(np.diff(first), 1).astype(np.float32)
    size = np.maximum(np.diff(at), 1).astype(np.float32)
    total = lambda values, of, k: np.bincount(of, weights=values, minlength=k)[:k].astype(np.float32)
    kinds = [np.diff(np.concatenate([[0], np.cumsum(k[data[at[0] : at[-1]]], dtype=np.float64)])[at - at[0]]) / size for k in _KIND]
    odd = _KIND[3][data[ends - 1]] if len(ends) else np.zeros(0)
    lone = ((ends - starts) == 1) * odd if len(ends) else np.zeros(0)
    seen = np.unique(text.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)) >> np.uint64(40)
    run = np.zeros(len(h), dtype=bool)
    run[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    shapes = np.stack([*kinds, total(odd, text, n) / words, total(lone, text, n) / words, np.bincount(seen.astype(np.int64), minlength=n)[:n] / words, total((ends - starts).astype(np.float32), text, n) / words / 10, total(run, text, n) / words, np.log1p(words) / 10, (words < 20).astype(np.float32), np.ones(n, np.float32)], axis=1).astype(np.float32)
    return pair >> BITS, pair & (1 << BITS) - 1, shapes


def fit(rows_: list[tuple], rounds: int = 400) -> np.ndarray:
    """Weights of a logistic model: words, then shapes. rows_: whole texts, as bytes or arrays of bytes, and 0 or 1."""
    y = np.array([r[1] for r in rows_], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return np.zeros((1 << BITS) + SHAPES, dtype=np.float32)
    doc, word, shape = [], [], []
    for lo in range(0, len(rows_), 500):
        part = [r[0] for r in rows_[lo : lo + 500]]
        data = np.concatenate([np.frombuffer(p, dtype=np.uint8) for p in part])
        d, w, s = features(data, np.concatenate([[0], np.cumsum([len(p) for p in part])]))
        doc.append((d + lo).astype(np.int32))
        word.append(w.astype(np.int32))
        shape.append(s)
    return _fit(np.concatenate(doc), np.concatenate(word), np.concatenate(shape), y, rounds)


def _fit(doc, word, shape, y, rounds: int) -> np.ndarray:
    n, v, n1 = len(y), 1 << BITS, float(y.sum())
    own, of = np.bincount(word, weights=y[doc], minlength=v), np.bincount(word, minlength=v)
    p = of / n
    differs = np.abs(own / n1 - (of - own) / (n - n1)) > ERRORS * np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    chosen = np.flatnonzero((of >= HELD) & differs)
    place = np.full(v, -1)
    place[chosen] = np.arange(len(chosen))
    doc, word = doc[place[word] >= 0], place[word[place[word] >= 0]]
    k = len(chosen)
    mean, dev = shape.mean(0), shape.std(0) + 1e-3
    mean[-1], dev[-1] = 0, 1
    z = (shape - mean) / dev
    w, m, s = np.zeros(k + SHAPES), np.zeros(k + SHAPES), np.zeros(k + SHAPES)
    for t in range(1, rounds + 1):
        r = (1 / (1 + np.exp(-(np.bincount(doc, weights=w[word], minlength=n) + z @ w[k:]).clip(-30, 30))) - y) / n
        g = np.concatenate([np.bincount(word, weights=r[doc], minlength=k), z.T @ r])
        g[:-1] += 1e-5 * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    w[-1] -= (w[k:-1] * mean[:-1] / dev[:-1]).sum()
    w[k:-1] /= dev[:-1]
    out = np.zeros(v + SHAPES, dtype=np.float32)
    out[chosen], out[v:] = w[:k], w[k:]
    return out


def log_odds(data: np.ndarray, at: np.ndarray, models) -> np.ndarray:
    doc, word, shape = features(data, at)
    return np.stack([np.bincount(doc, weights=w[word], minlength=len(at) - 1) + shape @ w[1 << BITS :] for w in models], axis=1)


def _scored(batches, models: np.ndarray, names: list[str]):
    for b in batches:
        at, data = utf8(b.column("text"))
        got = np.concatenate([log_odds(data, at[lo : hi + 1], models) for lo, hi in slices(at, AT_ONCE)] or [np.zeros((0, 2))]).clip(-30, 30)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got[:, 0]), pa.array(got[:, 1])], names=[*b.schema.names, *names])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Both models, fitted on at most `sample` labelled documents."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "q", "t").limit(sample)  # so many rows at most, hence small enough to broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    held = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow().sort_by("doc_id")
    at, data = utf8(held["text"])
    texts = [data[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
    q, t = held["q"].to_pylist(), held["t"].to_pylist()
    return np.stack([fit([(x, int(v == 0)) for x, v in zip(texts, q, strict=True) if v is not None]), fit([(x, int(v == 1)) for x, v in zip(texts, t, strict=True) if v is not None])])


def _rate(log_odds: str) -> Column:
    return 1 / (1 + F.exp(-F.col(log_odds)))


def _strength(sites: DataFrame, bad: str, parent: Column) -> Column:
    """Prior documents of a level: the beta-binomial strength whose variance between sites is the one seen."""
    p, n = F.col(bad) / F.col("n"), F.col("n")
    spread = F.sum(n * (p - parent) ** 2) / F.sum(n)
    own = F.sum(parent * (1 - parent)) / F.sum(n)  # of sampling alone
    between = F.greatest(spread - own, F.lit(1e-6))
    return F.least(F.greatest(F.sum(n * parent * (1 - parent)) / F.sum(n) / between - 1, F.lit(1.0)), F.lit(1e6))


def site_rates(scored: DataFrame) -> DataFrame:
    """(source, lang, shift_bad, shift_toxic): what each path adds to a document's log odds. scored: source, lang and the log odds _bad and _toxic."""
    logit = lambda p: F.log(p / (1 - p))
    held = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    paths = written(scored.groupBy("source", "lang").agg(F.count("*").cast("double").alias("n"), F.sum(_rate("_bad")).alias("bad"), F.sum(_rate("_toxic")).alias("toxic")), "paths")
    hosts = paths.groupBy("source").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic")))
    g = hosts.agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "toxic"))).select(*(held(F.col(f"all_{c}") / F.col("all_n")).alias(f"g_{c}") for c in ("bad", "toxic")))
    hosts = hosts.join(F.broadcast(g))
    of_hosts = hosts.agg(*(_strength(hosts, c, F.col(f"g_{c}")).alias(f"k_{c}") for c in ("bad", "toxic")))
    hosts = hosts.join(F.broadcast(of_hosts)).select("source", "g_bad", "g_toxic", *(held((F.col(c) + F.col(f"k_{c}") * F.col(f"g_{c}")) / (F.col("n") + F.col(f"k_{c}"))).alias(f"h_{c}") for c in ("bad", "toxic")))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.source").eqNullSafe(F.col("h.source"))).drop(F.col("h.source"))
    of_paths = both.agg(*(_strength(both, c, F.col(f"h_{c}")).alias(f"k_{c}") for c in ("bad", "toxic")))
    both = both.join(F.broadcast(of_paths))
    rate = lambda c: held((F.col(c) + F.col(f"k_{c}") * F.col(f"h_{c}")) / (F.col("n") + F.col(f"k_{c}")))
    return both.select("source", "lang", *((logit(rate(c)) - logit(F.col(f"g_{c}"))).alias(f"shift_{c}") for c in ("bad", "toxic")))


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], threshold: float = 0.5, sample: int = SAMPLE, names: tuple[str, str, str] = ("p_low", "p_toxic", "keep")) -> DataFrame:
    """columns of docs, with, under the given names, the probabilities of low quality and of toxic text, and keep (neither is above the threshold).

    Columns of docs may have any names but these three.
    """
    if clash := {c.lower() for c in columns} & {x.lower() for x in names}:
        raise ValueError(f"columns {sorted(clash)} are there already; give other names")
    bounded(docs.sparkSession)
    models = train(docs.select("doc_id", "text"), labels, sample)
    own = [f"c{i}" for i in range(len(columns))]  # the columns under names that can't clash
    need = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(columns, own, strict=True)), F.col("source").alias("site_source"), F.col("lang").alias("site_lang"), F.col("text").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in need.schema) + ", _bad double, _toxic double"
    scored = need.mapInArrow(partial(_scored, models=models, names=["_bad", "_toxic"]), schema).drop("text")
    scored = written(scored, "scored")
    sites = written(site_rates(scored.select(F.col("site_source").alias("source"), F.col("site_lang").alias("lang"), "_bad", "_toxic")), "sites")
    out = scored.join(sites, scored["site_source"].eqNullSafe(sites["source"]) & scored["site_lang"].eqNullSafe(sites["lang"]), "left")
    prob = lambda c: 1 / (1 + F.exp(-(F.col(f"_{c}") + F.coalesce(f"shift_{c}", F.lit(0.0)))))
    low, toxic, keep = names
    return out.select(*(F.col(o).alias(c) for c, o in zip(columns, own, strict=True)), prob("bad").alias(low), prob("toxic").alias(toxic), ((prob("bad") <= threshold) & (prob("toxic") <= threshold)).alias(keep))
