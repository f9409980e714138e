"""Subjects of documents by class-association rules.

Labelled documents are cut into sentences; each sentence is a transaction of its
subject-bearing words and the labels of its document. Parallel frequent-pattern
growth finds the frequent sets, those with a label become rules ``words -> subject``
with a confidence, redundant rules are pruned, and every sentence of the corpus is
scored by the calibrated evidence of the rules that match it. A document is about
the subjects that take up enough of its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut_lineage

#: Labelled documents the rules are mined from, at most (taken by hash of the id).
FIT_DOCUMENTS = 20_000
#: Sentences of one labelled document in the fit, evenly spaced: else a few very long texts would set every confidence.
FIT_SENTENCES = 60
#: Least share of the sentences that have a subject.
SHARE = 0.2
#: Sentences a rule must hold in, its least confidence, most words on its left.
MIN_COUNT, CONFIDENCE, WORDS = 5, 0.3, 2
#: Least chi-square (one degree) over documents of a word and a label, and least documents: words below bear no subject.
CHI_SQUARE, MIN_DOCUMENTS = 20.0, 3
#: Subjects that may be told apart; rules that may be sent to the tasks.
MOST_SUBJECTS, MOST_RULES = 10_000, 200_000
#: Evidence (natural log) by which the best subject of a sentence must lead; below, the document's other sentences decide.
LEAD = 1.0

_FRONT = re.compile(r"\A---\s*\n.*?\n---\s*(?:\n|\Z)", re.S)
_HEAD = re.compile(r"^(?:#{1,6}\s.*|=+ .* =+|.*\n(?:={3,}|-{3,}))\s*$", re.M)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?…]+(?=[\s\"'”»)*\]]|$)|\n\s*\n")
_LABEL = "\x01"


def sentences_of(text: str) -> list[list[str]]:
    """Lower-cased words of each sentence; frontmatter and headings are left out."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(_HEAD.sub("\n\n", _FRONT.sub("", text)).lower()):
        if token[0].isalpha():
            out[-1].append(token)
        elif out[-1]:
            out.append([])
    return [s for s in out if s]


def _fit_sentences(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, words, subjects) of the labelled documents in the fit.

    A label stands if at least half of the document's raters gave it.
    """
    votes = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id", "subject").agg(F.count_distinct(F.coalesce("rater", F.lit(""))).alias("n"))
    raters = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.count_distinct(F.coalesce("rater", F.lit(""))).alias("raters"))
    kept = votes.join(raters, "doc_id").filter(F.col("n") * 2 >= F.col("raters")).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    sample = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    # At most FIT_DOCUMENTS short rows.
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    # The same text under several ids counts once.
    rows = rows.groupBy(F.xxhash64("text").alias("_h"), F.length("text").alias("_n")).agg(F.min_by(F.struct("doc_id", "text", "subjects"), "doc_id").alias("r")).select("r.*")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, subjects in zip(batch["doc_id"], batch["text"], batch["subjects"]):
                found = sentences_of(text)
                if len(found) > FIT_SENTENCES:
                    found = [found[i * len(found) // FIT_SENTENCES] for i in range(FIT_SENTENCES)]
                out.extend((doc_id, no, sorted(set(w for w in s if len(w) > 2)), list(subjects)) for no, s in enumerate(found))
            yield pd.DataFrame(out, columns=["doc_id", "sentence_no", "words", "subjects"])

    return rows.mapInPandas(cut, "doc_id bigint, sentence_no int, words array<string>, subjects array<string>")


def mine_rules(documents: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """Pruned rules: words (tuple), subject, n_rule, n_words, confidence, prior.

    Words that no label stands out for (chi-square against the rest) are taken out of
    the transactions first, so the frequent sets stay few; rules that a rule of fewer
    words with the same subject matches in confidence are pruned.
    """
    sentences = cut_lineage(_fit_sentences(documents, labels))
    total = sentences.count()
    empty = pd.DataFrame(columns=["words", "subject", "n_rule", "n_words", "confidence", "prior"])
    if not total:
        return empty
    # What a word is about shows over documents; one long text repeats its words at will.
    by_doc = sentences.select("doc_id", F.explode("words").alias("word"), "subjects").distinct()
    docs = sentences.groupBy("doc_id").agg(F.first("subjects").alias("subjects"))
    n_docs = docs.count()
    per = docs.select(F.explode("subjects").alias("subject")).groupBy("subject").count().limit(MOST_SUBJECTS + 1)
    prior = {r[0]: r[1] / n_docs for r in per.collect()}
    if len(prior) > MOST_SUBJECTS:
        raise ValueError("more subjects than rules are mined for")
    # Documents of a word, with each subject and (under no subject) in all.
    counts = cut_lineage(by_doc.select("word", F.explode(F.concat("subjects", F.array(F.lit(None).cast("string")))).alias("subject")).groupBy("word", "subject").agg(F.count("*").alias("n")))
    single = counts.filter("subject is null").select("word", F.col("n").alias("m")).filter(F.col("m") >= MIN_DOCUMENTS)
    rate = F.element_at(F.create_map(*[x for k, v in prior.items() for x in (F.lit(k), F.lit(v))]), F.col("subject"))
    expected = F.col("m") * rate
    chi = (F.col("n") - expected) ** 2 / (expected * (1 - rate) + 1e-9)
    bearing = counts.filter("subject is not null").join(single, "word").filter((F.col("n") >= CONFIDENCE * F.col("m")) & (F.col("n") > expected) & (chi >= CHI_SQUARE)).select("word").distinct()
    # Words of at most FIT_DOCUMENTS * FIT_SENTENCES sentences, each in MIN_DOCUMENTS of them.
    chosen = sentences.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in bearing.collect()))

    def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for words, subjects in zip(batch["words"], batch["subjects"]):
                own = [w for w in words if w in chosen.value]
                if own:
                    out.append(own + [_LABEL + s for s in subjects])
            yield pd.DataFrame({"items": pd.Series(out, dtype=object)})

    items = sentences.select("words", "subjects").mapInPandas(moves, "items array<string>")
    items = cut_lineage(items)
    n = items.count()
    if not n:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, MIN_COUNT / n), minConfidence=1.0, numPartitions=8).fit(items)
    size = F.size(F.filter("items", lambda x: ~x.startswith(_LABEL)))
    sets = model.freqItemsets.withColumn("n_w", size).filter((F.col("n_w") >= 1) & (F.col("n_w") <= WORDS) & (F.size("items") - F.col("n_w") <= 1))
    found = sets.limit(MOST_RULES + 1).toPandas()
    if len(found) > MOST_RULES:
        raise ValueError("more rules than may be sent to the tasks; raise MIN_COUNT")
    left: dict[tuple, int] = {}
    rules = []
    for items_, freq in zip(found["items"], found["freq"]):
        words = tuple(sorted(w for w in items_ if not w.startswith(_LABEL)))
        subject = [w[1:] for w in items_ if w.startswith(_LABEL)]
        if subject:
            rules.append((words, subject[0], int(freq)))
        else:
            left[words] = int(freq)
    out = pd.DataFrame([(w, s, k, left[w], k / left[w], prior[s]) for w, s, k in rules if w in left], columns=empty.columns)
    out = out[(out["confidence"] >= CONFIDENCE) & (out["confidence"] > 1.5 * out["prior"])]
    alone = {(w[0], s): c for w, s, c in zip(out["words"], out["subject"], out["confidence"]) if len(w) == 1}
    redundant = [len(w) > 1 and max(alone.get((x, s), 0) for x in w) >= c for w, s, c in zip(out["words"], out["subject"], out["confidence"])]
    return out[~np.array(redundant, bool)].reset_index(drop=True)


class Scorer:
    """Evidence of the rules that match a sentence."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, int, int, float]]) -> None:
        self.subjects = sorted({r[1] for r in rules})
        at = {s: i for i, s in enumerate(self.subjects)}
        priors = np.zeros(len(self.subjects))
        held: dict[tuple[str, ...], dict[int, float]] = {}
        for words, subject, n_rule, n_words, prior in rules:
            priors[at[subject]] = prior
            # Confidence drawn to the prior by two sentences.
            held.setdefault(words, {})[at[subject]] = (n_rule + 2 * prior) / (n_words + 2)
        priors /= max(priors.sum(), 1e-9)
        self.by: dict[tuple[str, ...], np.ndarray] = {}
        for words, own in held.items():
            # What the rules of these words leave goes to the other subjects by their priors.
            share = np.zeros(len(self.subjects))
            for i, confidence in own.items():
                share[i] = confidence
            rest = np.where(share > 0, 0.0, priors)
            left = max(1.0 - share.sum(), 0.02)
            share = share + left * rest / max(rest.sum(), 1e-9)
            self.by[words] = np.log(np.maximum(share / share.sum(), 1e-3) / priors)
        self.single = {w[0]: v for w, v in self.by.items() if len(w) == 1}
        self.paired = {x for w in self.by if len(w) > 1 for x in w}

    def sentence(self, words: list[str]) -> np.ndarray | None:
        """Sum of the evidence by subject; None if no rule matches."""
        hits = [self.single[w] for w in set(words) if w in self.single]
        if self.paired:
            some = sorted({w for w in words if w in self.paired})
            hits += [self.by[a, b] for i, a in enumerate(some) for b in some[i + 1 :] if (a, b) in self.by]
        return np.sum(hits, 0) if hits else None

    def shares(self, text: str) -> dict[str, tuple[int, int]]:
        """subject -> (its sentences, sentences with a subject) of a whole text."""
        scores = [v for s in sentences_of(text) if (v := self.sentence(s)) is not None]
        if not scores:
            return {}
        table = np.array(scores)
        if len(self.subjects) > 1:
            top = np.partition(table, -2, axis=1)[:, -2:]
            clear = top[:, 1] - top[:, 0] >= LEAD
            counts = np.bincount(table[clear].argmax(1), minlength=len(self.subjects)) + 0.1
            table = np.where(clear[:, None], table, table + np.log(counts / counts.sum()))
        count = np.bincount(table.argmax(1), minlength=len(self.subjects))
        return {self.subjects[i]: (int(c), len(scores)) for i, c in enumerate(count) if c}


SHARES = "doc_id bigint, subject string, n_sentences int, n_with_subject int, share double"


def subject_shares(documents: DataFrame, rules: pd.DataFrame) -> DataFrame:
    """One row per document and subject that any of its sentences has: :data:`SHARES`.

    Whole texts are read, no row is shuffled. Null and empty texts, and texts in which
    no rule matches, have no rows. Repeated documents give repeated rows.
    """
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules")
    plain = [(tuple(w), s, int(k), int(m), float(p)) for w, s, k, m, p in zip(rules["words"], rules["subject"], rules["n_rule"], rules["n_words"], rules["prior"])]
    shared = documents.sparkSession.sparkContext.broadcast(plain)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text:
                    out.extend((doc_id, s, a, b, a / b) for s, (a, b) in scorer.shares(text).items())
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SHARES.split(", ")])

    return documents.filter("doc_id is not null").select("doc_id", "text").mapInPandas(score, SHARES)


def document_subjects(documents: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share): the subjects with at least ``share`` of the sentences that have one."""
    rules = mine_rules(documents, labels)
    out = subject_shares(documents, rules).filter(F.col("share") >= share)
    return out.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
