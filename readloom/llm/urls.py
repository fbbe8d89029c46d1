"""URL filtering: rules on host and path, then a classifier on words of both.

A host such as ``cheappills`` holds words without blanks between them. A
unigram model over the words of a public vocabulary gives each word a
probability (Zipf's law over its rank), and Viterbi decoding finds the split of
greatest probability. Multinomial naive Bayes scores the tokens of host and
path: all labels of the host, its port, and digits too. It is fitted on the labelled names below, which are few and fixed; no row
of the data is used, so a verdict never depends on other rows.

Defined results: a null url, or one without ``://``, has empty host and path
and no token, and gets the verdict of the prior (allow); rules are tried on it
all the same; of fitting rules of equal length ``block`` wins; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.arrow import map_batches

_RUNS = re.compile("[a-z]+|[0-9]+|[^\x00-\x7f]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled names on which the classifier is fitted: fixed values.
BLOCK_NAMES = """
cheap pills / buy viagra online / discount pharmacy meds / casino win / online casino bonus / poker slots jackpot
free bets / sports betting odds / lottery winner prize / adult x / adult video cams / xxx sex tube / hot escort dating
porn free videos / spam farm / link farm seo / ads track / ad tracker click / popup ads banner / pay per click traffic
payday loan fast cash / get rich quick crypto / fake rolex replica watches / warez crack keygen serial / torrent pirate movies
phishing account verify login / malware download exe / miracle weight loss diet / free gift card prize / work from home money
"""
ALLOW_NAMES = """
daily news / city library / university press / science journal / history museum / public school / weather report
travel guide / cooking recipes / music review / film archive / art gallery / open source docs / software forum / tech blog
health clinic / garden club / football league / local council / national park / language dictionary / world atlas
book store / photo album / research institute / community center / mountain hotel / family doctor / river bridge / science video
"""
#: Names that say nothing: they stand in both classes.
NEUTRAL_NAMES = """
www / m / blog / en / de / fr / es / page / article / category / post / archive / index html / about / contact
"""


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    rule = action = F.lit(None).cast("string")
    for act, text in reversed(ordered):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


class Words:
    """Unigram probabilities of words, from the ranks of a public vocabulary."""

    def __init__(self, path: str, end: str = "</w>", longest: int = 24):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranked = sorted((i, x[: -len(end)]) for x, i in vocabulary.items() if x.endswith(end))
        words = [x for _, x in ranked if x.isascii() and x.isalpha() and (len(x) > 2 or x in ("an", "at", "by", "in", "is", "it", "my", "no", "of", "on", "or", "to", "up", "us", "we", "ad", "x"))]
        total = sum(1 / (r + 30) for r in range(len(words)))
        self.log_p = {x: -math.log((r + 30) * total) for r, x in enumerate(words)}
        self.longest = longest
        self.letter = -math.log(len(words)) - 4.0

    def split(self, name: str) -> list[str]:
        """The most probable words of a run of letters; unknown runs stay whole letters, joined."""
        n = len(name)
        best, last, known = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        get = self.log_p.get
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                p = get(name[j:i])
                if p is not None and best[j] + p > best[i]:
                    best[i], last[i], known[i] = best[j] + p, j, True
            if best[i - 1] + self.letter > best[i]:
                best[i], last[i], known[i] = best[i - 1] + self.letter, i - 1, False
        out: list[str] = []
        i, run = n, n
        while i > 0:
            if known[i]:
                if run > i:
                    out.append(name[i:run])
                out.append(name[last[i] : i])
                run = last[i]
            i = last[i]
        if run > 0:
            out.append(name[:run])
        return out[::-1]


class NaiveBayes:
    """Multinomial naive Bayes; tokens never seen in fitting say nothing."""

    def __init__(self, names: dict[str, Iterable[list[str]]], prior: dict[str, float], add: float = 0.5):
        counts = {label: Counter(t for name in rows for t in name) for label, rows in names.items()}
        seen = set().union(*counts.values())
        self.prior = {label: math.log(p) for label, p in prior.items()}
        self.log_p = {
            t: {label: math.log((c[t] + add) / (c.total() + add * (len(seen) + 1))) for label, c in counts.items()} for t in seen
        }

    def probability(self, tokens: Iterable[str], label: str) -> float:
        score = dict(self.prior)
        for t in tokens:
            for k, v in self.log_p.get(t, {}).items():
                score[k] += v
        top = max(score.values())
        parts = {k: math.exp(v - top) for k, v in score.items()}
        return parts[label] / sum(parts.values())


class Judge:
    """Tokens and block probability of a host and a path."""

    def __init__(self, vocabulary_path: str, block_prior: float):
        self.words = Words(vocabulary_path)
        self.segment = lru_cache(1 << 16)(lambda name: tuple(self.words.split(name)))
        read = lambda text: [sum((list(self.segment(w)) for w in name.split()), []) for name in re.split(r"[/\n]", text) if name.strip()]
        self.model = NaiveBayes({"block": read(BLOCK_NAMES + NEUTRAL_NAMES), "allow": read(ALLOW_NAMES + NEUTRAL_NAMES)}, {"block": block_prior, "allow": 1 - block_prior})
        self.of_host = lru_cache(1 << 16)(self._host_tokens)

    def _runs(self, text: str) -> Iterator[str]:
        """Words of runs of letters; runs of digits and of characters beyond ASCII as they are."""
        for run in _RUNS.findall(text):
            if not "a" <= run[0] <= "z":
                yield run
            elif len(run) <= 64:
                yield from self.segment(run)
            else:
                yield from self.words.split(run)

    def _host_tokens(self, host: str) -> tuple[str, ...]:
        return tuple(self._runs(host))

    def tokens(self, host: str, path: str) -> list[str]:
        return [*self.of_host(host), *self._runs(path.translate(str.maketrans(_UPPER, _LOWER)))]

    def block_probability(self, tokens: list[str]) -> float:
        return self.model.probability(tokens, "block")


def judge_urls(
    df: DataFrame,
    rules: Iterable[tuple[str, str]],
    vocabulary_path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    block_prior: float = 0.3,
    threshold: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score, tokens)."""
    rows = df.select(df[id_col].cast("bigint").alias("page_id"), df[url_col].cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def make():
        judge = Judge(vocabulary_path, block_prior)

        def work(batch):
            tokens = [judge.tokens(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            scores = [judge.block_probability(t) for t in tokens]
            return [*batch.columns, pa.array(scores, pa.float64()), pa.array([" ".join(t) for t in tokens], pa.string())]

        return work

    scored = map_batches(rows, "page_id bigint, host string, path string, block_score double, tokens string", "path", make)
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "block_score", "tokens")
