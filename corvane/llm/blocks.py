"""Main content of pages: a recurrent labeller of text blocks.

Each non-blank line of a page is a block, its description is one more at the front. A block is read as the mean of its
hashed-word vectors and of the vectors of its path (see `path_of`): how the line is marked, cut into items, cased, ended
and placed on its page - what its place in the page's markup leaves behind in plain text. A bidirectional LSTM in numpy runs over
the blocks of the page, so every block is judged in the context of the whole document, and a logistic unit gives the
probability that the block is furniture of the site.

There are no true labels. The labeller is fitted on the driver on at most `FIT_PAGES` pages (those of smallest hash, the
same ones at any number of partitions), whose blocks get weak labels from five votes (`votes_of`):

* wording - whether the block begins with one of the common phrases below, and its share of common words of site furniture;
* matter  - its share of words that belong to the matter of a page: words that stand in several blocks of the pages that have
  them, far more often than their number of pages lets expect. Counted over all pages;
* copies  - under how many different keys the same block stands, as a share of the pages. Counted over all pages;
* shape   - sentence, list of items, label with items, few words;
* place   - description, first or last lines, inside.

How reliable each vote is, is learned without labels by expectation maximisation over the counts of vote patterns, and the
labeller is fitted on the posteriors. The counts go over all pages in one pass, and only for words and blocks that the fitted
pages have, so what reaches the driver is bounded by these. The weights have a fixed size (about 0.7 MB) and go
to the executors; every page is then labelled there in Arrow batches, without a shuffle. A fitted labeller can be kept
(`save_labeller`, `load_labeller`) and applied to other pages.

Defined results: null and empty texts have no blocks; blank lines are no cases and stay out of the cleaned text; lines end
at a line feed and count from 1, blank ones too; pages and lines of any number and length are read whole; equal pages get
equal labels. With no page to fit on, no block is furniture. A null group counts as no key. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forms import transducer

#: How many pages the labeller is fitted on at most, in how many steps, and of how many pages each.
FIT_PAGES, STEPS, BATCH = 3000, 300, 64
BUCKETS, PATHS, WIDTH, HIDDEN, KNOWN = 8192, 512, 20, 24, 4

#: From how many pages a word can be told to be matter of pages, and how much more often than by chance it stands in several blocks.
LEAST_PAGES, MATTER = 4, 3.0
ROUNDS = 30

#: Common phrases with which furniture of sites begins, lower case.
PHRASES = """
skip to content;back to top;terms of use;privacy policy;copyright 0;©;all rights reserved;follow us;share this;sign up for;log in to;we use cookies
cookies help us;accept all;advertisement;powered by;related ;you might also like;you are here;tags:;filter by;recent posts;trending now;report a problem
zum inhalt springen;nach oben;impressum;erstellt mit;seite teilen;newsletter;ähnliche ;wir verwenden cookies;werbung;du bist hier;schlagwörter
aller au contenu;haut de page;mentions légales;propulsé par;partager;nous utilisons des cookies;abonnez-vous;publicité;vous êtes ici;connectez-vous
saltar al contenido;volver arriba;aviso legal;funciona con;compartir;usamos cookies;suscríbete;publicidad;estás aquí
"""
#: What navigation lists are made of.
NAVIGATION = """
about archive blog boards contact download faq gallery help home log in members news search settings sign up
anmelden archiv hilfe impressum kontakt mitglieder neuigkeiten startseite suche über uns
accueil actualités aide archives à propos connexion contact membres mentions légales recherche
acerca de archivo aviso legal ayuda buscar contacto entrar inicio miembros noticias
"""
#: Other common words of furniture.
COMMON = """
accept account advertisement agree allow also apps back categories comment comments consent content contributors cookie cookies copy copyright daily
device follow forum friends guests imprint leave licence license like liked link login logout manage menu might miss navigation necessary
newest newsletter next nodes oldest online policy popular powered preferences previous print privacy problem profile rating readers
recent recommended register reject related reply report reserved rights send share similar site sitemap skip sponsored status stores subscribe
systems tags tell terms theme tips top trending updates use version visit browsing choices collective continuing partners
abonnieren ablehnen akzeptieren anzeige beliebt dateien datenschutz drucken einstellungen einwilligung erlauben erstellt folgen gerät inhalt
kommentieren kopieren nutzung nutzungsbedingungen notwendige oben rechte registrieren rundbrief schlagwörter seite senden speichern springen
stimmst teilen urheberrecht verwandte verwenden vorbehalten werbung zustimmen ähnliche
abonnez accepter acceptez aller améliorer appareil applications choix commentaire commenter conditions confidentialité connectez contenu copier
droits enregistrement envoyer fichiers gérer haut imprimer inscription lettre partager poursuivant propulsé préférences publicité refuser réservés
similaires suivez utilisons êtes ici
aceptar aceptas aquí archivos arriba boletín comentar comentario compartir contenido continuar copiar derechos dispositivo enviar estás funciona
gestionar guardemos imprimir mejorar parecidas preferencias privacidad publicidad rechazar registrarse reservados saltar similares suscríbete
síguenos usamos volver
"""
#: Function words by which the language of a page is told, as words are rare or frequent within one.
TONGUES = {"en": "the and of with from this", "de": "der die das und mit von", "fr": "les des et une dans pour", "es": "los las el una con por"}
_TONGUE = {w: t for t, ws in TONGUES.items() for w in ws.split()}
_OPENINGS = tuple(c for line in PHRASES.strip().split("\n") for c in line.split(";"))
_NAV = sorted({w for w in NAVIGATION.split()}, key=len, reverse=True)
_NAV_LINE = re.compile(rf"(?:(?:{'|'.join(_NAV)})[\s|/·»>,•]*){{2,}}[^\s|/·»>,]{{0,10}}")
#: Words of furniture of more than two letters, without those that any sentence may have.
FURNITURE_WORDS = frozenset(w for w in (NAVIGATION + COMMON).split() if len(w) > 2 and w != "about")
_LEAD = re.compile(r"^(?:\[x\] ?|[^\w«©]+)+")
_TAIL = re.compile(r"(?:\s*(?:\[\d+\]|ok|✕|▼))*\W*$")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
#: Where one block may have run into the next.
_JOINS = re.compile(r" [·|] |(?<=[a-zäöüéàß.])(?=[A-ZÄÖÜÉÀ©])")
_MARKS = [(s, f" {s} ") for s in "|/·»>,•"]
_ITEMS = re.compile(r"\s[|/·»>,•]\s|, ")
_END = re.compile(r"[.!?…]\W*$")
_LABEL = re.compile(r"\W*[^:]{2,24}: ")
_HUMP = re.compile(r"(?<=[^\W\d_A-ZÄÖÜÉÀ])(?=[A-ZÄÖÜÉÀ])")


def bare(form: str) -> str:
    """The block without marks before and after, lower case, digits as 0."""
    return re.sub(r"\d+", "0", _TAIL.sub("", _LEAD.sub("", form.lower())))


def cue(form: str) -> bool:
    """Whether a block, in consistent form, or a part of it begins with a common phrase of furniture or is a navigation list."""
    parts = [bare(form), *(map(bare, joined) if len(joined := _JOINS.split(form)) > 1 else ())]
    return any(p.startswith(_OPENINGS) or _NAV_LINE.fullmatch(p) for p in (parts[0], parts[min(1, len(parts) - 1)], parts[-1]))


def tongue_of(forms: Iterable[str]) -> str:
    """The language of most function words of a page, empty without any."""
    seen = Counter(t for f in forms for w in split_words(f) if (t := _TONGUE.get(w)))
    return min(seen, key=lambda t: (-seen[t], t)) if seen else ""


@dataclass
class Counts:
    """Over all pages: their number by language, of each word of a language how many pages have it and how many have it in
    several blocks, of each bare block under how many keys it stands."""

    pages: dict[str, int]
    words: dict[tuple[str, str], tuple[int, int]]
    blocks: dict[str, int]

    def frequent(self, tongue: str, word: str) -> bool:
        return self.words.get((tongue, word), (0, 0))[0] >= LEAST_PAGES

    def matter(self, tongue: str, word: str) -> bool:
        n, several = self.words.get((tongue, word), (0, 0))
        return n >= LEAST_PAGES and word not in FURNITURE_WORDS and several * self.pages.get(tongue, 0) >= MATTER * n * n


#: How many levels each vote has: wording, matter, shape with and without words of furniture, copies, place.
LEVELS = (5, 3, 12, 4, 5)


def votes_of(page: list[tuple[int, str]], counts: Counts) -> list[tuple[int, ...]]:
    """The votes on each block of a page."""
    lines, tongue, pages, out = sum(1 for n, _ in page if n), tongue_of(f for _, f in page), sum(counts.pages.values()), []
    for step, (n, form) in enumerate(page):
        words, nth = split_words(form), step - (len(page) - lines)
        weighty = [w for w in words if w in FURNITURE_WORDS or (len(w) > 3 and counts.frequent(tongue, w))]
        share = sum(w in FURNITURE_WORDS for w in words) / max(1, len(weighty))
        matter = len({w for w in words if counts.matter(tongue, w)}) / max(1, len(weighty))
        copies, ended, items = counts.blocks.get(bare(form), 0), bool(_END.search(form)), len(_ITEMS.findall(form))
        wording = 4 if cue(form) else 0 if share == 0 else 1 if share < 1 / 3 else 2 if share < 2 / 3 else 3
        if ended and matter and items < 3 and wording < 4:  # a sentence on the matter of the page may name such words
            wording = min(wording, 1)
        if not ended and len(words) <= 14 and _LABEL.match(form):
            shape = 5
        else:
            shape = 0 if len(words) >= 9 and ended and items < 3 else 1 if items >= 2 else 2 if len(words) <= 3 else 3 if ended else 4
        place = 0 if n == 0 else 1 if nth == 0 else 2 if nth == lines - 1 else 3 if nth in (1, lines - 2) else 4
        rate = copies / max(1, pages)
        out.append((wording, 0 if matter == 0 else 1 if matter < 0.3 else 2, 2 * shape + (share >= 0.2), 0 if copies < 2 else 1 if rate < 0.003 else 2 if rate < 0.02 else 3, place))
    return out


def agreed(votes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The posterior of each row of votes under a model in which they are independent given the hidden answer. It starts from
    the wording, and from the matter where the wording says nothing."""
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    wording, matter = patterns[:, 0], patterns[:, 1]
    yes = np.select([wording == 4, (wording == 3) & (matter == 0), (wording == 2) & (matter == 0), matter > 0], [0.97, 0.7, 0.5, 0.03], 0.1)
    for _ in range(rounds):
        score = np.full(len(patterns), np.log((n @ yes + 1) / (n @ (1 - yes) + 1)))
        for j, size in enumerate(LEVELS):
            a, b = np.bincount(patterns[:, j], n * yes, size) + 1, np.bincount(patterns[:, j], n * (1 - yes), size) + 1
            score += np.log(a / a.sum() / (b / b.sum()))[patterns[:, j]]
        yes = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return yes[at.reshape(-1)]


def path_of(form: str, description: bool, nth: int, of: int) -> list[str]:
    """The steps from the page to the block, as far as plain text shows them."""
    if description:
        place = "description"
    else:
        place = ("first", "second", "third")[nth] if nth < 3 else ("last", "last but one")[of - 1 - nth] if of - nth < 3 else "inside"
    lead = _LEAD.match(form)
    n = len(form.split())
    parts = [s for s, spaced in _MARKS if form.count(spaced) + (form.count(", ") if s == "," else 0) > 1]
    case = "upper" if form.isupper() else "title" if form.istitle() else "mixed" if _HUMP.search(form) else "plain"
    end = form[-1:] if form[-1:] in ".:?!✕▼]" else "word"
    size = f"size {min(n.bit_length(), 6)}"
    steps = [place, f"mark {lead[0].strip()[:1] if lead else ''}", f"items {''.join(parts)}", f"case {case}", f"end {end}", size, f"digits {min(sum(map(str.isdigit, form)), 3)}"]
    return steps + [f"{size} {steps[2]}", f"{size} end {end}"]


@lru_cache(maxsize=20_000)
def _path(step: str) -> int:
    return zlib.crc32(step.encode()) % PATHS


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


@lru_cache(maxsize=20_000)
def split_words(form: str) -> tuple[str, ...]:
    """Lower-case words, numbers as 0; run-together list items are told apart at their capitals."""
    return tuple("0" if w[0].isdigit() else w for w in _WORDS.findall(_HUMP.sub(" ", form).lower()))


def words_of(form: str, known: frozenset[str] | None = None) -> list[int]:
    """Buckets of the block's words and its first ones; words that aren't known, as invented names, all count as one, long
    ones also by their parts."""
    words = [w if known is None or w in known else "?" for w in split_words(form)]
    out = [_bucket("^" + " ".join(words[:n])) for n in (1, 2, 3) if words]
    for w in words:
        out.append(_bucket(w))
    for w in split_words(form):
        if len(w) > 13 and known is not None and w not in known:
            out += [_bucket("+" + w[k : k + 5]) for k in range(0, len(w) - 4)]
    return out or [_bucket("")]


def blocks_of(description: str | None, snippet: str | None) -> list[tuple[int, str]]:
    """(line_no, consistent form) of the page's blocks; 0 is the description."""
    form = transducer()
    lines = [(0, form(description))] if description else []
    if snippet:
        lines += [(n, form(line)) for n, line in enumerate(snippet.split("\n"), 1)]
    return [(n, f) for n, f in lines if f]


class Features:
    """Hashed words and paths of the blocks of some pages, with each block's place in a padded (page, step) grid."""

    def __init__(self, pages: list[list[tuple[int, str]]], known: frozenset[str] | None = None):
        words, paths, counts, self.at = [], [], [], []
        self.length = np.array([len(p) for p in pages])
        for k, page in enumerate(pages):
            lines = [n for n, _ in page if n]
            for step, (n, form) in enumerate(page):
                w = words_of(form, known)
                words += w
                counts.append(len(w))
                nth = step - (len(page) - len(lines))
                paths.append([*map(_path, path_of(form, n == 0, nth, len(lines)))])
                self.at.append(k * max(int(self.length.max()), 1) + step)
        self.words, self.counts = np.array(words, np.int64), np.array(counts, np.int64)
        self.paths = np.array(paths, np.int64).reshape(len(counts), -1)
        self.at = np.array(self.at, np.int64)
        self.steps = max(int(self.length.max()), 1) if len(pages) else 1
        self.mask = (np.arange(self.steps)[None, :] < self.length[:, None]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by their number."""
    return np.stack([np.bincount(at, rows[:, k], size) for k in range(rows.shape[1])], 1).astype(rows.dtype)


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output; `w` holds all weights by name."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = 2 * WIDTH, HIDDEN
        self.w = {"words": rng.normal(0, 0.3, (BUCKETS, WIDTH)), "paths": rng.normal(0, 0.3, (PATHS, WIDTH)), "out": rng.normal(0, 0.3, 2 * h + d), "bias": np.zeros(1)}
        for way in "fb":
            self.w |= {f"x{way}": rng.normal(0, d**-0.5, (d, 4 * h)), f"h{way}": rng.normal(0, h**-0.5, (h, 4 * h)), f"c{way}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.known: frozenset[str] | None = None

    def features(self, pages: list[list[tuple[int, str]]]) -> Features:
        return Features(pages, self.known)

    def read(self, f: Features) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(f.counts)])[:-1]
        words = np.add.reduceat(self.w["words"][f.words], starts) / f.counts[:, None]
        x = np.zeros((len(f.length) * f.steps, 2 * WIDTH), np.float32)
        x[f.at] = np.concatenate([words, self.w["paths"][f.paths].mean(1)], 1)
        return x.reshape(len(f.length), f.steps, 2 * WIDTH)

    def run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """The states after each step; backwards, the padding comes first and leaves the state at zero."""
        xs, ms = (x, mask) if way == "f" else (x[:, ::-1], mask[:, ::-1])
        z_x, hh, n = xs @ self.w[f"x{way}"] + self.w[f"c{way}"], HIDDEN, len(x)
        h, c, out, kept = np.zeros((n, hh), np.float32), np.zeros((n, hh), np.float32), np.empty((n, x.shape[1], hh), np.float32), []
        for t in range(x.shape[1]):
            z = z_x[:, t] + h @ self.w[f"h{way}"]
            gates, g, m = _sigmoid(z[:, : 3 * hh]), np.tanh(z[:, 3 * hh :]), ms[:, t, None]
            i, keep, o = gates[:, :hh], gates[:, hh : 2 * hh], gates[:, 2 * hh :]
            c_new = keep * c + i * g
            th = np.tanh(c_new)
            kept.append((h, c, i, keep, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, t] = h
        return (out if way == "f" else out[:, ::-1]), kept

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray, way: str, grad: dict) -> np.ndarray:
        xs, ds = (x, d_out) if way == "f" else (x[:, ::-1], d_out[:, ::-1])
        dh = dc = np.zeros_like(ds[:, 0])
        dz = np.empty((*ds.shape[:2], 4 * HIDDEN), np.float32)
        for t in reversed(range(ds.shape[1])):
            h, c, i, keep, o, g, th, m = kept[t]
            dh = dh + ds[:, t]
            d_new = m * dh
            d_cell = m * dc + d_new * o * (1 - th * th)
            dz[:, t] = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * keep * (1 - keep), d_new * th * o * (1 - o), d_cell * i * (1 - g * g)], 1)
            dh = dz[:, t] @ self.w[f"h{way}"].T + (1 - m) * dh
            dc = d_cell * keep + (1 - m) * dc
        before = np.stack([k[0] for k in kept], 1)
        flat = dz.reshape(-1, 4 * HIDDEN)
        grad[f"x{way}"], grad[f"h{way}"], grad[f"c{way}"] = xs.reshape(-1, xs.shape[2]).T @ flat, before.reshape(-1, HIDDEN).T @ flat, flat.sum(0)
        dx = (flat @ self.w[f"x{way}"].T).reshape(xs.shape)
        return dx if way == "f" else dx[:, ::-1]

    def forward(self, f: Features) -> tuple:
        x = self.read(f)
        (hf, kf), (hb, kb) = self.run(x, f.mask, "f"), self.run(x, f.mask, "b")
        top = np.concatenate([hf, hb, x], 2)
        return x, kf, kb, top, _sigmoid(top @ self.w["out"] + self.w["bias"])

    def probabilities(self, f: Features) -> np.ndarray:
        """Of each block, in the order of the pages and blocks."""
        return self.forward(f)[4].reshape(-1)[f.at]

    def gradient(self, f: Features, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, kf, kb, top, p = self.forward(f)
        d = np.zeros(p.size, np.float32)
        d[f.at] = (p.reshape(-1)[f.at] - labels) / len(labels)
        d = d.reshape(p.shape)
        grad = {"out": top.reshape(-1, top.shape[2]).T @ d.reshape(-1), "bias": np.array([d.sum()], np.float32)}
        d_top = d[:, :, None] * self.w["out"]
        dx = d_top[:, :, 2 * HIDDEN :] + self.back(x, kf, d_top[:, :, :HIDDEN], "f", grad) + self.back(x, kb, d_top[:, :, HIDDEN : 2 * HIDDEN], "b", grad)
        dx = dx.reshape(-1, 2 * WIDTH)[f.at]
        grad["words"] = _summed(f.words, np.repeat(dx[:, :WIDTH] / f.counts[:, None], f.counts, 0), BUCKETS)
        grad["paths"] = _summed(f.paths.reshape(-1), np.repeat(dx[:, WIDTH:] / f.paths.shape[1], f.paths.shape[1], 0), PATHS)
        return grad

    def fit(self, pages: list[list[tuple[int, str]]], labels: list[list[float]], steps: int = STEPS, rate: float = 0.01) -> Labeller:
        """Adam on the mean cross-entropy, pages of similar length together, in an order fixed by the seed. Words of fewer than
        `KNOWN` of the pages are left unknown, so that the labeller learns what to make of those it will not know."""
        seen = Counter(w for page in pages for w in {w for _, form in page for w in split_words(form)})
        self.known = frozenset(w for w, n in seen.items() if n >= KNOWN)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [[k for k in order[a : a + BATCH] if pages[k]] for a in range(0, len(order), BATCH)]
        ready = [(self.features([pages[k] for k in b]), np.array([x for k in b for x in labels[k]], np.float32)) for b in batches if b]
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        rng, step = np.random.default_rng(2), 0
        while ready and step < steps:
            for k in rng.permutation(len(ready))[: steps - step]:
                step += 1
                for name, g in self.gradient(*ready[k]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    scale = rate * (1 - (step - 1) / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                    self.w[name] -= (scale * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        return self


def page_blocks(pages: DataFrame, key: str, group: str) -> DataFrame:
    """(id, key, numbers, forms, lines): the blocks of each page, `key` its group; pages without blocks have empty lists."""
    kinds = dict(pages.dtypes)

    def read(batches):
        for batch in batches:
            rows = batch.to_pydict()
            numbers, forms, lines = [], [], []
            for description, snippet in zip(rows["description"], rows["snippet"], strict=True):
                found, raw = blocks_of(description, snippet), (snippet or "").split("\n")
                numbers.append([n for n, _ in found])
                forms.append([f for _, f in found])
                lines.append([raw[n - 1] if n else description for n, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(numbers, pa.list_(pa.int32())), pa.array(forms, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.string()))], names=["id", "key", "numbers", "forms", "lines"])

    return pages.select(F.col(key).alias("id"), F.col(group).alias("key"), "description", "snippet").mapInArrow(read, f"id {kinds[key]}, key {kinds[group]}, numbers array<int>, forms array<string>, lines array<string>")


def count_over(blocks: DataFrame, pages: list[list[tuple[int, str]]]) -> Counts:
    """Counts over all of `blocks`, of the words and blocks of these pages. Tasks add up before anything is shuffled."""
    wanted = ({w for page in pages for _, f in page for w in split_words(f)}, {bare(f) for page in pages for _, f in page})
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        words, forms = shared.value
        got, stand = {}, set()

        def flushed():
            rows = [*((w, t, None, a, b) for (t, w), (a, b) in got.items()), *((f, None, k, 0, 0) for f, k in stand)]
            got.clear()
            stand.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["what", "tongue", "key", "n", "several"])

        for batch in batches:
            for key, page in zip(batch.column("key").to_pylist(), batch.column("forms").to_pylist(), strict=True):
                tongue, here = tongue_of(page), Counter(w for f in page for w in {*split_words(f)} & words)
                for w, times in [*here.items(), ("", 1)]:
                    a, b = got.get((tongue, w), (0, 0))
                    got[tongue, w] = (a + 1, b + (times > 1))
                if key is not None:
                    stand.update((b, key) for f in page if (b := bare(f)) in forms)
            if len(got) + len(stand) > 200_000:
                yield flushed()
        yield flushed()

    counted = blocks.select(F.col("key").cast("string").alias("key"), "forms").mapInArrow(count, "what string, tongue string, key string, n bigint, several bigint")
    per_key = counted.groupBy("what", "tongue", "key").agg(F.sum("n").alias("n"), F.sum("several").alias("several"))
    rows = per_key.groupBy("what", "tongue").agg(F.sum("n").alias("n"), F.sum("several").alias("several"), F.count("key").alias("keys")).collect()
    words = {(r.tongue, r.what): (r.n, r.several) for r in rows if r.tongue is not None}
    return Counts({t: n for (t, w), (n, _) in words.items() if w == ""}, words, {r.what: r["keys"] for r in rows if r.tongue is None})


def fit_labeller(blocks: DataFrame, most: int = FIT_PAGES) -> Labeller | None:
    """Fitted on the `most` different pages of smallest hash of `page_blocks`; None without pages. A first cut by the hash keeps
    what reaches the driver near `most` rows at any size; copies may leave it a little short of them."""
    near = int(min(1.0, 1.5 * most / max(1, blocks.count())) * (1 << 30)) + (1 << 12)
    hashed = blocks.select("numbers", "forms", F.shiftrightunsigned(F.xxhash64("numbers", "forms"), 34).alias("h")).where((F.col("h") < near) & (F.size("forms") > 0))
    sample = hashed.dropDuplicates(["h"]).orderBy("h").limit(most).collect()
    pages = [list(zip(r.numbers, r.forms, strict=True)) for r in sorted(sample, key=lambda r: r.h)]
    if not pages:
        return None
    counts = count_over(blocks, pages)
    labels = iter(agreed(np.array([v for page in pages for v in votes_of(page, counts)])).tolist())
    return Labeller().fit(pages, [[next(labels) for _ in page] for page in pages])


def save_labeller(spark: SparkSession, labeller: Labeller, path: str) -> None:
    """As a table of weights and known words."""
    rows = [(k, list(v.shape), v.tobytes(), None) for k, v in labeller.w.items()] + [("known", None, None, sorted(labeller.known or ()))]
    spark.createDataFrame(rows, "name string, shape array<int>, weights binary, words array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load_labeller(spark: SparkSession, path: str) -> Labeller:
    out = Labeller()
    for r in spark.read.parquet(path).collect():
        if r.name == "known":
            out.known = frozenset(r.words)
        else:
            out.w[r.name] = np.frombuffer(r.weights, np.float32).reshape(r["shape"])
    return out


def label_blocks(blocks: DataFrame, key: str, labeller: Labeller | None, lines: bool = True) -> DataFrame:
    """(key, line_no, line, furniture): all of `page_blocks`, with the probability that each is furniture; without the column
    `line` if `lines` is false."""
    kind = dict(blocks.dtypes)["id"]
    shared = blocks.sparkSession.sparkContext.broadcast((labeller.w, labeller.known) if labeller else None)

    def label(batches):
        model = Labeller() if shared.value is not None else None
        if model:
            model.w, model.known = shared.value
        for batch in batches:
            rows = batch.to_pydict()
            for a in range(0, len(rows["id"]), 512):
                part = sorted((k for k in range(a, min(a + 512, len(rows["id"]))) if rows["forms"][k]), key=lambda k: len(rows["forms"][k]))
                for c in range(0, len(part), 64):
                    group = part[c : c + 64]
                    pages = [list(zip(rows["numbers"][k], rows["forms"][k], strict=True)) for k in group]
                    p = model.probabilities(model.features(pages)) if model else np.zeros(sum(map(len, pages)))
                    cols = [pa.array([rows["id"][k] for k, page in zip(group, pages, strict=True) for _ in page], batch.schema.field("id").type), pa.array([n for page in pages for n, _ in page], pa.int64())]
                    cols += [pa.array([x for k in group for x in rows["lines"][k]], pa.string())] if lines else []
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64())], names=names)

    names = [key, "line_no", *["line"] * lines, "furniture"]
    schema = ", ".join([f"`{key}` {kind}", "line_no bigint", *["line string"] * lines, "furniture double"])
    return blocks.select("id", "numbers", "forms", *["lines"] * lines).mapInArrow(label, schema)


def main_content(blocks: DataFrame, key: str, labeller: Labeller | None) -> DataFrame:
    """(key, description, snippet): of every page, only what the labeller takes for its own content, lines as they stand
    without trailing blanks. Null where nothing is left."""
    own = label_blocks(blocks, key, labeller).where("furniture < 0.5")
    lines = F.sort_array(F.collect_list(F.when(F.col("line_no") > 0, F.struct("line_no", F.rtrim(F.regexp_replace("line", r"\s+$", "")).alias("line")))))
    kept = own.groupBy(key).agg(F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("description"), F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("snippet"))
    joined = blocks.select(F.col("id").alias(key)).join(kept, key, "left")
    return joined.select(key, "description", F.when(F.col("snippet") != "", F.col("snippet")).alias("snippet"))
