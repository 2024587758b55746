"""Quality rules as weak supervision.

Eight rules vote good, bad or abstain on the statistics of a whole text.
Expectation-maximisation over the counts of all vote patterns of the corpus
(at most 3**8 rows) estimates the prior and each rule's accuracy on good and
on bad texts; a document's verdict is its posterior probability of being
good, instead of passing every rule.

Words are maximal runs of characters other than blank and U+0009 to U+000D.
A null text has no words.  Texts of fewer than ten words, or with more than a
fifth of their words in repeated five-word windows, fail whatever the votes.
Repeated rows get equal verdicts; an empty table gives an empty result.  Only
``doc_id`` and ``text`` are read by the query; the stage form passes all other
columns through unread, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.llm.common import map_texts, staged

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbols", "dup_lines", "repeats", "word_length", "length", "distinct", "capitals", "marks"]
KEEP_AT = 0.5           # least posterior probability of a good text
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?#*$%&|<>"


def statistics(text: str | None) -> tuple[int, ...]:
    """``COUNTS``, then words, lines with a word, distinct words, capitals, marked words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()          # splits at blank and U+0009 to U+000D only
    n = len(words)
    if not n:
        return (0,) * 9
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, bool)
        for shift in range(5):
            covered[shift:shift + len(again)] |= again
        repeated = int(covered.sum())
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(set(words)),
            len(raw) - len(raw.translate(None, _CAPITALS)),
            sum(w[-1] in _MARKS for w in words))


def votes(s: tuple[int, ...]) -> str:
    """One of ``+-0`` (good, bad, abstain) for each of ``RULES``."""
    n, chars, symbols, dup, repeated, lines, distinct, capitals, marks = map(int, s)

    def vote(bad: bool, good: bool) -> str:
        return "-" if bad else "+" if good else "0"

    return "".join([
        vote(10 * symbols > 3 * n, 20 * symbols <= n),
        vote(10 * dup > 3 * lines, lines > 1 and dup == 0),
        vote(10 * repeated > n, n > 5 and repeated == 0),
        vote(chars < 2 * n or chars > 15 * n, 3 * n <= chars <= 10 * n),
        vote(n < 15, n >= 40),
        vote(n >= 30 and 10 * distinct < 3 * n, n >= 30 and 2 * distinct > n),
        vote(10 * capitals > 3 * chars, 20 * capitals < 3 * chars),
        vote(5 * marks > n, 20 * marks <= n),
    ])


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def label_model(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior of a good text for each vote pattern, by EM over their counts.

    A rule names one defect: nearly all good texts pass it, and so do bad texts
    of other defects.  So accuracies start at 0.97 on good and 0.4 on bad texts
    and keep to bounds within which a bad vote always counts against a text;
    pseudo-counts of a fiftieth of the corpus hold them near their start.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    good = np.array([[c == "+" for c in k] for k in keys], float)
    bad = np.array([[c == "-" for c in k] for k in keys], float)
    prior, on_good, on_bad = 0.8, np.full(good.shape[1], 0.97), np.full(good.shape[1], 0.4)
    strength = count.sum() / 50
    posterior = np.full(len(keys), prior)
    for _ in range(rounds):
        yes = np.log(prior) + good @ np.log(on_good) + bad @ np.log(1 - on_good)
        no = np.log(1 - prior) + good @ np.log(1 - on_bad) + bad @ np.log(on_bad)
        posterior = 1 / (1 + np.exp(np.clip(no - yes, -700, 700)))
        w, v = count * posterior, count * (1 - posterior)
        prior = float(np.clip((w.sum() + 0.8 * strength) / (count.sum() + strength), 0.02, 0.98))
        on_good = np.clip((w @ good + 0.97 * strength) / (w @ (good + bad) + strength), 0.9, 0.9999)
        on_bad = np.clip((v @ bad + 0.4 * strength) / (v @ (good + bad) + strength), 0.2, 0.99)
    return dict(zip(keys, posterior.tolist()))


def rule_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``COUNTS`` and the vote pattern of every document."""
    def work(texts):
        s = [statistics(t) for t in texts]
        return [*zip(*[x[:5] for x in s]), [votes(x) for x in s]] if s else [[]] * 6

    return map_texts(docs, {**{c: pa.int64() for c in COUNTS}, "pattern": pa.string()}, lambda: work)


def fit_posteriors(patterns: DataFrame) -> dict[str, float]:
    """EM over the counts of all patterns; at most 3**8 rows reach the driver."""
    return label_model({r.pattern: r["count"] for r in patterns.groupBy("pattern").count().collect()})


def weak_rules_query(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    counts = staged(rule_counts(docs), "rules")
    posterior = fit_posteriors(counts)
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "pattern string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (counts.join(F.broadcast(table), "pattern", "left")   # at most 3**8 rows
            .select("doc_id", *COUNTS, failed.alias("base_failed"),
                    (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    Texts are read twice (once for the votes of the whole corpus, once for
    the verdict) rather than written or shuffled.
    """
    posterior = fit_posteriors(rule_counts(docs))
    text = next(c for c in docs.columns if c.lower() == "text")

    def task(batches):
        for b in batches:
            s = [statistics(t) for t in b.column(text).to_pylist()]
            kept = [not base_failed(x[0], x[4]) and posterior.get(votes(x), 0.0) >= KEEP_AT for x in s]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
