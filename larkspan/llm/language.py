"""Operator 4, language identification by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.shared import named, numbered

#: n-grams in a profile and in a document's list.
PROFILE = 400
#: About so many documents of each language are read to fit its profile, chosen by a hash of the id.
SAMPLE = 2000
#: Languages whose counts are broadcast at most.
LANGUAGES = 10_000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the 1- to 3-grams of the lower-cased letters; a run of other code points is one space; grams do not cross words.

    A key packs three code points of 21 bits, a missing one is 0.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letter()[c], c, 32)
    c = np.concatenate(([32], c, [32]))
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = c[keep]
    blank = c == 32
    if blank.all():
        return none
    one = c[~blank]
    two = (c[:-1] << 21 | c[1:])
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[~blank[1:-1]]
    keys = np.concatenate((one, two, three))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _top(keys: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent keys, most frequent first, ties to the smaller key."""
    if len(keys) > k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        at = np.flatnonzero(n >= least)
    else:
        at = np.arange(len(n))
    return keys[at[np.argsort(-n[at], kind="stable")]][:k]


def fit(labelled: DataFrame, profile: int = PROFILE, sample: int = SAMPLE, seed: int = 5) -> dict[str, np.ndarray]:
    """Profiles from (doc_id, text, lang): each language's most frequent n-grams over about `sample` documents (all, where it has fewer).

    Bound: `sample` documents and `profile` keys a language. Rows with null lang or text teach nothing.
    """
    x = labelled.where(F.col("lang").isNotNull())
    share = x.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("p"))
    share = F.broadcast(share) if share.limit(LANGUAGES + 1).count() <= LANGUAGES else share  # else all texts of a language would meet in one task
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    x = x.where("text is not null").join(share, "lang").where(chance < F.col("p")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                found = [grams(t) for t in texts]
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "key": keys, "n": np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)})

    total = x.mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= profile)
    out: dict[str, list] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["key"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def judge(texts: pd.Series, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> tuple[list[str], list[float]]:
    names = sorted(profiles)
    every = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.empty(0, np.int64)
    place = np.full((len(names), len(every) + 1), -1, np.int64)
    for i, k in enumerate(names):
        place[i, np.searchsorted(every, profiles[k])] = np.arange(len(profiles[k]))
    langs, scores = [], []
    for text in texts:
        keys = _top(*grams(text), profile) if names else []
        if not len(keys):
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        at = np.searchsorted(every, keys)
        at[at < len(every)] = np.where(every[at[at < len(every)]] == keys[at < len(every)], at[at < len(every)], len(every))
        there = place[:, at]
        far = np.where(there < 0, profile, np.minimum(np.abs(there - np.arange(len(keys))), profile)).sum(1)
        best = int(far.argmin())
        langs.append(names[best])
        scores.append(1.0 - float(far[best]) / (profile * len(keys)))
    return langs, scores


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """docs plus lang_pred (a language of the profiles, or und) and lang_score (1: all n-grams in place, 0: none known).

    Reads nothing but text, the whole of it. Null and empty texts, texts without a letter, and all texts if there are no profiles: und, 0.
    Equal distances go to the first language by name. Repeated rows stay; an empty table stays empty. Any other columns are kept, whatever
    their names; lang_pred and lang_score replace columns of these names.
    """
    from pyspark.sql import types as T

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, scores = judge(texts, profiles, profile)
            yield pd.DataFrame({"lang_pred": langs, "lang_score": scores})

    x, at = numbered(docs)
    return named(x.withColumn("found", guess(at["text"])), at, lang_pred=F.col("found.lang_pred"), lang_score=F.col("found.lang_score"))
