"""The subjects of each document, from labelling functions whose accuracies are learned.

Lexicon. On a bounded sample of the labelled documents (at most `FIT_LABELS` labels, those of smallest hash), terms are
counted by the labels of their documents. Terms whose share of one subject is high beyond chance make the lexicon; words
that are frequent in a few subjects are ambiguous and count only within a telling pair of words. Labels may be wrong or
missing: a term needs several documents. A sentence is about the subject whose terms in it weigh most; one of mostly
furniture words ("Terms of use | Privacy") is about none.

The lexicon then grows over all documents, labelled or not: words that stand almost only in texts plainly about one subject
join it. So the words of languages and themes with few labels are found. All that qualify join, however many: the
`MOST_GROWN` most frequent are broadcast, the rest reach the texts that hold them by a join on the word.

Labelling functions, each giving every (document, subject) pair with any such sentence one of a few votes:
* lexicon - the share of the document's sentences about the subject, in `SHARES` steps around the definition's fifth;
* section - what the headings of the document's sections say, by their own words, which are no sentences: that they name this
  subject or only others; it abstains without such headings;
* address - whether the app under the document's address is itself about the subject by its title and description; it abstains
  without such an app;
* source  - the kind of document, each source and null with a vote of its own.

A latent model with one hidden yes or no per pair starts from the lexicon's vote, whose meaning the definition gives: a fifth is
yes, a twelfth no, and midway between them it is open (`FIRST`). It learns from all documents, without labels, how
reliable the other votes are (expectation maximisation over counts of vote patterns, of which there are at most 63 a source
whatever the number of documents; more than `MOST_PATTERNS` of them stay in a table, one row a source, and each round is a sum
over it). A document has a subject where the posterior is at least one half.

Plan: two passes over the texts in Arrow batches, one to grow the lexicon and one to vote; no text is shuffled, the votes are joined with the apps on the address
(ids and numbers only), and vote patterns are counted with map-side combining before they reach the driver. Only where more
than `MOST_GROWN` words qualify, one more pass gives the different words of each text for the join, and texts are shuffled once.

Defined results: null, empty and blank texts, texts without any term of a subject have no rows; headings without a sentence
and lines without words are no sentences; unclean characters are read in their consistent form; whole texts are read. Without
labels the lexicon is empty and so is the result. Repeated texts get the same subjects as long as source and address agree.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .blocks import NAVIGATION, PHRASES
from .forms import altered, transducer

#: Labels used at most, documents a term needs, and the lower bound of the share of its subject.
FIT_LABELS, LEAST_DOCUMENTS, TELLING, AMBIGUOUS = 20_000, 4, 0.55, 0.28
#: The same for words learned from texts without labels, and how many of these, of at most so many letters, are broadcast.
LEAST_GROWN, TELLING_GROWN, MOST_GROWN, LONGEST_GROWN = 8, 0.6, 50_000, 64
#: From these shares of sentences on, the lexicon's vote is one step higher. A fifth is the definition of a subject, a twelfth
#: or less that of a passing mention.
SHARES = (1 / 12 + 1e-9, 1 / 8, 0.15, 0.175, 0.2 - 1e-9, 0.3)
ROUNDS = 40
#: Patterns of votes that may reach the driver.
MOST_PATTERNS = 20_000
#: The votes other than the source, and how many levels each has.
LEVELS = {"lex": len(SHARES) + 1, "sec": 3, "adr": 3}
#: How sure the definition makes of a subject at each of the lexicon's levels: even midway between a twelfth and a fifth, at 0.142.
FIRST = (0.02, 0.2, 0.45, 0.7, 0.9, 0.97, 0.99)

_WORDS = re.compile(r"[^\W\d_]+")
#: What stands for a sentence's last sign, for "#" and for all else that is neither letter nor blank. `str.split` takes them for blanks.
_END, _HEAD, _OTHER = "\x1e", "\x1d", "\x1f"


@lru_cache(maxsize=10_000)
def _kind(c: str) -> str:
    """The character itself if words are made of it or it ends a line, else what stands for its kind."""
    if c == "\n" or _WORDS.fullmatch(c):
        return c
    return " " if c.isspace() else _END if c in ".!?…" else _HEAD if c == "#" else _OTHER


_ASCII = bytes(range(128))
_KINDS = bytes(ord(_kind(chr(i))) for i in range(128)) + bytes(range(128, 256))


#: The words that furniture of sites is made of; a sentence of mostly these is about no subject, whatever it names.
_FURNITURE = {w for w in _WORDS.findall(PHRASES + NAVIGATION + " imprint nodes runs status systems normal collective rights reserved content licence contributors theme") if len(w) > 3}
_FURNITURE |= set("confidentialité conditions droits réservés datenschutz nutzungsbedingungen rechte vorbehalten privacidad condiciones derechos reservados".split())
MOSTLY = 0.6
#: Items of navigation lists may have run together.
_LISTED = tuple(w for w in NAVIGATION.split() if len(w) > 2)


def furniture(words: list[str]) -> bool:
    long = [w for w in words if len(w) > 12]
    if not long and _FURNITURE.isdisjoint(words):
        return False
    here = sum(map(_FURNITURE.__contains__, words)) + sum(w not in _FURNITURE and w.startswith(_LISTED) for w in long)
    if len(words) > 6 and 5 * here < len(words):
        return False
    return here >= MOSTLY * max(1, sum(len(w) > 3 for w in words))


def _beyond_ascii(text: bytes) -> str:
    return text.translate(None, _ASCII).decode("utf-8", "surrogatepass")


def readable(text: str) -> str:
    """The text in consistent form, line by line, where it holds characters that the form may alter; where these are few, only
    the parts between blanks that hold them. The form of a part is that of the same part of its line, but for the order of marks
    after a blank, of which no word is made."""
    if text.isascii() or not (many := len(altered().findall(_beyond_ascii(text.encode("utf-8", "surrogatepass"))))):
        return text
    form, found = transducer(), altered().search
    if 2 * many > text.count(" "):
        return "\n".join(map(form, text.split("\n")))
    return "\n".join([" ".join([form(x) if not x.isascii() and found(x) else x for x in line.split(" ")]) for line in text.split("\n")])


def lines_of(text: str) -> Iterator[tuple[bool, list[list[str]]]]:
    """Of each line, whether it is a heading, and the lower-case words of its sentences. Words are runs of letters; a sentence ends
    at one of .!?… before a blank. All characters but letters are replaced by their kinds in whole texts, so that splitting
    at fixed strings is left."""
    raw = readable(text).lower().encode("utf-8", "surrogatepass")
    text = raw.translate(_KINDS).decode("utf-8", "surrogatepass")
    if not text.isascii():
        kinds = {c: _kind(c) for c in set(_WORDS.sub("", _beyond_ascii(raw)))}
        if len(kinds) > 32:
            text = text.translate(str.maketrans(kinds))
        else:
            for c, kind in kinds.items():
                text = text.replace(c, kind)
    for line in text.split("\n"):
        words = [w for s in line.split(f"{_END} ") if (w := s.split())]
        if words:
            yield line.lstrip(" ").startswith(_HEAD), words


def terms_of(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


class Lexicon:
    """Words and pairs of words with their subject and weight, and the ambiguous words."""

    #: (word, k, weight) of the grown words that are not broadcast; the table itself stays with the driver.
    rest: DataFrame | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rest"}

    def __init__(self, rows: list, subjects: list[str], prior: list[float]):
        self.subjects = subjects
        self.word: dict[str, tuple[int, float]] = {}
        self.pair: dict[str, tuple[int, float]] = {}
        pairs, self.ambiguous = {}, set()
        for term, n, shares in rows:
            p = np.array(shares) / n
            k = int(p.argmax())
            low = p[k] - (p[k] * (1 - p[k]) / n) ** 0.5 - 0.5 / n
            if low > TELLING:
                entry = (k, float(np.log((shares[k] + 0.5) / (n + 2) / max(prior[k], 0.02))))
                (pairs if " " in term else self.word)[term] = entry
            elif " " not in term and low > AMBIGUOUS:
                self.ambiguous.add(term)
        self.pair = {t: e for t, e in pairs.items() if any(w in self.ambiguous for w in t.split(" "))}
        self.index()

    def index(self) -> None:
        """One look-up for each word: its subject and weight, subject -1 for the ambiguous."""
        self.entry = {**dict.fromkeys(self.ambiguous, (-1, 0.0)), **self.word}

    def sentence(self, words: list[str]) -> int:
        """The subject of a sentence, -1 for none."""
        hits = list(filter(None, map(self.entry.get, words)))
        if not hits:
            return -1
        first = hits[0][0]
        if first >= 0 and all([k == first for k, _ in hits]):
            return -1 if furniture(words) else first
        score: dict[int, float] = {}
        for k, x in hits:
            score[k] = score.get(k, 0.0) + x
        if -1 in score:
            del score[-1]
            for i, w in enumerate(words):
                if w in self.ambiguous:
                    e = (self.pair.get(f"{words[i - 1]} {w}") if i else None) or (self.pair.get(f"{w} {words[i + 1]}") if i + 1 < len(words) else None)
                    if e:
                        score[e[0]] = score.get(e[0], 0.0) + e[1]
        return max(score, key=lambda k: (score[k], -k)) if score and not furniture(words) else -1

    def read(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(subject, share of sentences, vote of the headings, sentences) of a text."""
        if not text or not self.word:
            return []
        total, of, heads = 0, defaultdict(int), set()
        for heading, sentences in lines_of(text):
            here = [self.sentence(words) for words in sentences if len(words) > 1 or heading]
            if heading:
                heads.update(k for k in here if k >= 0)
                continue
            total += len(here)
            for k in here:
                if k >= 0:
                    of[k] += 1
        return sorted((k, n / total, (1 + (k in heads)) * bool(heads), total) for k, n in of.items())

    def evidence(self, text: str | None) -> tuple[int, set[str]]:
        """The one subject that a text is plainly about, -1 for none, and its words that the lexicon lacks, furniture
        aside."""
        if not text or not self.word:
            return -1, set()
        sentences = [words for _, line in lines_of(text) for words in line]
        of, total = Counter(map(self.sentence, sentences)), len(sentences)
        of.pop(-1, None)
        if not of:
            return -1, set()
        k = max(of, key=lambda x: (of[x], -x))
        if of[k] < 2 or of[k] < 0.15 * total or of[k] < 0.8 * sum(of.values()):
            return -1, set()
        return k, self.lacking(set().union(*sentences))

    def lacking(self, words: set[str]) -> set[str]:
        """Those of the words that are not in the lexicon but may join it."""
        return {w for w in words.difference(self.entry, _FURNITURE) if len(w) > 3 and not (len(w) > 12 and w.startswith(_LISTED))}

    def learn(self, rows: list) -> Lexicon:
        """With further words, of (word, subject, weight)."""
        self.word.update((w, (k, x)) for w, k, x in rows)
        self.index()
        return self

    @contextmanager
    def along(self, rows: list | None) -> Iterator[Lexicon]:
        """The lexicon with the entries of `rest` that one text needs."""
        more = {r["word"]: (r["k"], r["weight"]) for r in rows or ()}
        self.entry.update(more)
        try:
            yield self
        finally:
            for w in more:
                del self.entry[w]

    def main(self, text: str | None) -> int:
        found = self.read(text)
        return max(found, key=lambda x: (x[1], -x[0]))[0] if found else -1


def tallied(got: dict[tuple[int, ...], Counter], size: int) -> tuple[list[str], np.ndarray]:
    """The terms counted by the subjects of their texts, and a row for each of `size` subjects, to which a text of several gives
    equal parts of one, and one for the number of texts."""
    terms = list(set().union(*got.values()))
    place, rows = {t: i for i, t in enumerate(terms)}, np.zeros((size + 1, len(terms)))
    for of, counts in got.items():
        at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        rows[size, at] += n
        for k in of:
            rows[k, at] += n / len(of)
    return terms, rows


def fit_lexicon(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = FIT_LABELS) -> Lexicon:
    """From the texts of the labelled documents; the labels are cut by hash to `most`, so they may be broadcast."""
    known = labels.where(F.col("subject").isin(subjects)).select("doc_id", "subject").distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(most).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("_subjects"))
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id").select("text", "_subjects").withColumn("_h", F.xxhash64("text", "_subjects")).dropDuplicates(["_h"])
    index = {s: k for k, s in enumerate(subjects)}
    names = [f"s{k}" for k in range(len(subjects))]

    def count(batches):
        got: dict[tuple[int, ...], Counter] = defaultdict(Counter)

        def flushed():
            terms, rows = tallied(got, len(names))
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *map(pa.array, rows)], names=["term", *names, "n"])

        for batch in batches:
            for text, of in zip(batch.column("text").to_pylist(), batch.column("_subjects").to_pylist(), strict=True):
                terms = set()
                for _, sentences in lines_of(text):
                    terms |= terms_of([w for words in sentences for w in words])
                got[tuple(map(index.__getitem__, of))].update((*terms, ""))
            if sum(map(len, got.values())) > 200_000:
                yield flushed()
        yield flushed()

    counted = texts.mapInArrow(count, "term string, " + ", ".join(f"{c} double" for c in [*names, "n"]))
    summed = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in [*names, "n"]])
    top = F.greatest(*names) / F.col("n") if len(names) > 1 else F.col(names[0]) / F.col("n")
    kept = summed.where((F.col("term") == "") | ((F.col("n") >= LEAST_DOCUMENTS) & (top > AMBIGUOUS))).collect()
    rows = [(r.term, r.n, [r[c] for c in names]) for r in sorted(kept, key=lambda r: r.term)]
    whole = next((r for r in rows if r[0] == "" and r[1]), None)
    prior = [x / whole[1] for x in whole[2]] if whole else [1.0] * len(names)
    return Lexicon([r for r in rows if r[0]], subjects, prior)


def telling(n: int, shares: list[int], prior: list[float]) -> tuple[int, float] | None:
    """Subject and weight of a word of `n` texts, so many by subject, if it tells the subject."""
    k = max(range(len(shares)), key=lambda j: (shares[j], -j))
    p = shares[k] / n
    return (k, float(np.log((shares[k] + 0.5) / (n + 2) / max(prior[k], 0.02)))) if p - (p * (1 - p) / n) ** 0.5 - 0.5 / n > TELLING_GROWN else None


def grow_lexicon(documents: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon with words that stand, over all documents, almost only in texts plainly about one subject. Counts are
    combined in the tasks and again before the shuffle; the words of most texts, `MOST_GROWN`, reach the driver, and the
    others stay in the table `rest`."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    size = len(lexicon.subjects)
    names = [f"s{k}" for k in range(size)]

    def count(batches):
        got: dict[tuple[int, ...], Counter] = defaultdict(Counter)

        def flushed():
            words, rows = tallied(got, size)
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *map(pa.array, rows[:size].astype(np.int64))], names=["word", *names])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                k, words = shared.value.evidence(text)
                if k >= 0:
                    got[k,].update((*words, ""))
            if sum(map(len, got.values())) > 200_000:
                yield flushed()
        yield flushed()

    counted = documents.select("text").where("text IS NOT NULL").mapInArrow(count, "word string, " + ", ".join(f"{c} bigint" for c in names))
    summed = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).withColumn("n", sum((F.col(c) for c in names), F.lit(0)))
    top = F.greatest(*names) if size > 1 else F.col(names[0])
    counts = materialize(summed.where((F.col("word") == "") | ((F.col("n") >= LEAST_GROWN) & (top > TELLING_GROWN * F.col("n")))))
    whole = counts.where("word = ''").first()
    if whole is None:
        return lexicon
    prior = [whole[c] / whole.n for c in names]

    def weigh(batches):
        for batch in batches:
            found = [telling(n, shares, prior) for n, *shares in zip(*[batch.column(c).to_pylist() for c in ("n", *names)], strict=True)]
            at = [i for i, e in enumerate(found) if e]
            k, weight = pa.array([found[i][0] for i in at], pa.int32()), pa.array([found[i][1] for i in at], pa.float64())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), k, weight], names=["word", "n", "k", "weight"])

    grown = counts.where("word <> ''").select("word", "n", *names).mapInArrow(weigh, "word string, n bigint, k int, weight double")
    short = F.length("word") <= LONGEST_GROWN
    sent = grown.where(short).orderBy(F.desc("n"), "word").limit(MOST_GROWN).collect()
    beyond = ~short
    if len(sent) == MOST_GROWN:
        last = sent[-1]
        beyond = beyond | (F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("word") > last.word))
    rest = grown.where(beyond).select("word", "k", "weight")
    lexicon.learn([(r.word, r.k, r.weight) for r in sent])
    if not rest.isEmpty():
        lexicon.rest = rest
    return lexicon


def with_rest(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`texts` with the column `more`: those entries of the lexicon's `rest` whose words stand in the text. Texts are known by
    their hash; should two share one, each has entries that it does not look up."""
    if lexicon.rest is None:
        return texts.withColumn("more", F.lit(None).cast("array<struct<word: string, k: int, weight: double>>"))
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def words(batches):
        for batch in batches:
            for h, text in zip(batch.column("_h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                here = list(shared.value.lacking({w for _, line in lines_of(text) for words in line for w in words}))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(here), pa.int64()), pa.array(here, pa.string())], names=["_h", "word"])

    keyed = texts.withColumn("_h", F.xxhash64("text"))
    lists = keyed.where("text IS NOT NULL").select("_h", "text").mapInArrow(words, "_h bigint, word string").distinct()
    more = lists.join(lexicon.rest, "word").groupBy("_h").agg(F.collect_list(F.struct("word", "k", "weight")).alias("more"))
    return keyed.join(more, "_h", "left").drop("_h")


def votes(documents: DataFrame, apps: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, subject index, share, lex, sec, adr, src): the votes on each pair of a document and a subject it mentions."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def read(batches):
        for batch in batches:
            rows = []
            for i, (text, more) in enumerate(zip(batch.column("text").to_pylist(), batch.column("more").to_pylist(), strict=True)):
                with shared.value.along(more) as own:
                    rows += [(i, k, share, level) for k, share, level, _ in own.read(text)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("source").take(at), batch.column("contract_key").take(at), *[pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int32()), (2, pa.float64()), (3, pa.int32()))]], names=["doc_id", "source", "contract_key", "k", "share", "sec"])

    def about(batches):
        for batch in batches:
            mains = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("more").to_pylist(), strict=True):
                with shared.value.along(more) as own:
                    mains.append(own.main(text))
            yield pa.RecordBatch.from_arrays([batch.column("contract_key"), pa.array(mains, pa.int32())], names=["contract_key", "own"])

    found = with_rest(documents.select("doc_id", "text", "source", "contract_key"), lexicon).mapInArrow(read, "doc_id bigint, source string, contract_key string, k int, share double, sec int")
    own = with_rest(apps.select("contract_key", F.concat_ws(".\n", "title", "description").alias("text")), lexicon).mapInArrow(about, "contract_key string, own int")
    own = own.where("own >= 0 AND contract_key IS NOT NULL").groupBy("contract_key").agg(F.collect_set("own").alias("own"))
    lex = sum((F.col("share") >= s).cast("int") for s in SHARES)
    adr = F.when(F.col("own").isNull(), 0).when(F.array_contains("own", F.col("k")), 2).otherwise(1)
    joined = found.join(own, "contract_key", "left")
    return joined.select("doc_id", "k", "share", lex.alias("lex"), "sec", adr.alias("adr"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"))


def _anchor(level: np.ndarray) -> np.ndarray:
    first = np.array(FIRST)[level]
    return np.log(first / (1 - first))


def learn(patterns: list[tuple[tuple, int]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """The posterior of each pattern (lexicon vote first, source last) under a model in which the votes are independent given the
    hidden answer. The lexicon's vote stands as the definition has it; level 0 of the votes between abstains."""
    if not patterns:
        return {}
    keys, n = [p for p, _ in patterns], np.array([c for _, c in patterns], float)
    anchor, codes = _anchor(np.array([p[0] for p in keys])), []
    columns = list(zip(*keys, strict=True))[1:]
    for j, values in enumerate(columns):
        speaks = np.array([j == len(columns) - 1 or v != 0 for v in values])
        levels = {v: i for i, v in enumerate(sorted({v for v, s in zip(values, speaks, strict=True) if s}))}
        codes.append((np.flatnonzero(speaks), np.array([levels[v] for v, s in zip(values, speaks, strict=True) if s], int), len(levels)))
    yes = 1 / (1 + np.exp(-anchor))
    for _ in range(rounds):
        score = anchor.copy()
        for at, code, size in codes:
            a, b = np.bincount(code, (n * yes)[at], size) + 1, np.bincount(code, (n * (1 - yes))[at], size) + 1
            score[at] += np.log(a / a.sum() / (b / b.sum()))[code]
        yes = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(keys, yes.tolist(), strict=True))


def _replayed(counts: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]], sources: int) -> np.ndarray:
    """The answers for the patterns of some sources (a row each) after the rounds of which `history` has the sums over all
    sources, of the patterns for yes and for no."""
    level = np.indices(tuple(LEVELS.values())).reshape(len(LEVELS), -1)
    anchor = _anchor(level[0])
    yes = np.broadcast_to(1 / (1 + np.exp(-anchor)), counts.shape)
    for a, b in history:
        score = anchor.copy()
        for code, size in list(zip(level, LEVELS.values(), strict=True))[1:]:
            at = code > 0
            seen = np.bincount(code[at], (a + b)[at], size) > 0
            x, y = ((np.bincount(code[at], v[at], size) + 1) * seen for v in (a, b))
            score += np.where(at, np.log(np.where(seen, x, 1) / max(x.sum(), 1) / (np.where(seen, y, 1) / max(y.sum(), 1)))[code], 0)
        x, y = ((counts * v).sum(1) + 1 for v in (yes, 1 - yes))
        score = score + np.log(x / (a.sum() + sources) / (y / (b.sum() + sources)))[:, None]
        yes = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return yes


def learn_apart(counted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`learn` for any number of sources: (lex, sec, adr, src, posterior) of the patterns in (lex, sec, adr, src, n). Only sums
    over all sources, of 63 numbers, reach the driver."""
    size = int(np.prod([*LEVELS.values()]))
    cell = (F.col("lex") * LEVELS["sec"] + F.col("sec")) * LEVELS["adr"] + F.col("adr")
    table = materialize(counted.groupBy("src").agg(F.collect_list(F.struct(cell.cast("int").alias("cell"), "n")).alias("cells")))
    sources = table.count()

    def counts_of(batch):
        out = np.zeros((batch.num_rows, size))
        for i, cells in enumerate(batch.column("cells").to_pylist()):
            for c in cells:
                out[i, c["cell"]] += c["n"]
        return out

    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):

        def sums(batches, history=tuple(history)):
            a, b = np.zeros(size), np.zeros(size)
            for batch in batches:
                counts = counts_of(batch)
                yes = _replayed(counts, history, sources)
                a += (counts * yes).sum(0)
                b += (counts * (1 - yes)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([a.tolist()], pa.list_(pa.float64())), pa.array([b.tolist()], pa.list_(pa.float64()))], names=["a", "b"])

        parts = table.mapInArrow(sums, "a array<double>, b array<double>").collect()
        history.append((np.sum([r.a for r in parts], 0), np.sum([r.b for r in parts], 0)))

    def answers(batches):
        for batch in batches:
            counts = counts_of(batch)
            i, c = np.nonzero(counts)
            levels = np.unravel_index(c, tuple(LEVELS.values()))
            yes = _replayed(counts, history, sources)[i, c]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in levels], batch.column("src").take(pa.array(i)), pa.array(yes)], names=["lex", "sec", "adr", "src", "posterior"])

    return table.mapInArrow(answers, "lex int, sec int, adr int, src string, posterior double")


def subject_posteriors(documents: DataFrame, labels: DataFrame, areas: DataFrame, apps: DataFrame) -> DataFrame:
    """(doc_id, subject, share, posterior) of every pair of a document and a subject that it mentions. `areas` is a fixed
    small table of subjects."""
    spark = documents.sparkSession
    subjects = sorted({r.subject for r in areas.select("subject").collect() if r.subject})
    lexicon = grow_lexicon(documents, fit_lexicon(documents, labels, subjects))
    pairs = materialize(votes(documents, apps, lexicon))
    cols = ["lex", "sec", "adr", "src"]
    counted = materialize(pairs.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")))
    few = counted.limit(MOST_PATTERNS + 1).collect()
    if len(few) > MOST_PATTERNS:
        posterior = learn_apart(counted)
    else:
        learned = [(*p, x) for p, x in learn(sorted((tuple(r[c] for c in cols), r["n"]) for r in few)).items()]
        posterior = F.broadcast(spark.createDataFrame(learned, "lex int, sec int, adr int, src string, posterior double"))
    name = F.element_at(F.array(*map(F.lit, subjects)), F.col("k") + 1) if subjects else F.lit("")
    return pairs.join(posterior, cols).select("doc_id", name.alias("subject"), "share", "posterior")


def subjects_found(documents: DataFrame, labels: DataFrame, areas: DataFrame, apps: DataFrame) -> DataFrame:
    """(doc_id, subject) where the posterior is one half or more."""
    return subject_posteriors(documents, labels, areas, apps).where("posterior >= 0.5").select("doc_id", "subject")
