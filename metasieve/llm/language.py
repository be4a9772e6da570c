"""Language identification of mixed-language text.

The scripts of a word's letters narrow the languages it can be in. Each word
gets a score by language from its character n-grams, and a Viterbi pass with a
penalty for every switch labels the words; runs of one label are spans. The
document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_rows, discard, fresh_name, stored, texts_to_python, trimmed

# First code points of Unicode ranges and the script of each, "" for none of its own.
SCRIPT_RANGES = [
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00AA, "Latin"), (0x00AB, ""),
    (0x00B5, "Latin"), (0x00B6, ""), (0x00BA, "Latin"), (0x00BB, ""), (0x00C0, "Latin"), (0x0250, "Latin"), (0x02B0, ""),
    (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""),
    (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""),
    (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, ""),
    (0x20000, "Han"), (0x323B0, ""),
]
_STARTS = [a for a, _ in SCRIPT_RANGES]

UNDETERMINED = "und"
#: A word's score for a language is at most this far below its best one.
_WORST = 8.0


def script_of(char: str) -> str:
    return SCRIPT_RANGES[bisect.bisect_right(_STARTS, ord(char)) - 1][1]


def letters_of(token: str) -> str:
    """The letters of a token in lower case."""
    low = token.lower()
    return low if low.isalpha() else "".join(c for c in low if c.isalpha())


def grams(word: str) -> list[str]:
    """Runs of three characters of a word with its ends marked."""
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class LanguageModel:
    """Scores of n-grams and words by language, and the languages of each script."""

    languages: list[str]
    gram_rows: dict[str, int]
    gram_scores: np.ndarray
    scripts: dict[str, np.ndarray]
    switch_penalty: float = 10.0


def fit_language_model(texts: list[str], langs: list[str], switch_penalty: float = 10.0, most_grams: int = 100_000) -> LanguageModel:
    """Learns from labelled texts; without any, every text is ``und``.

    Of the n-grams, the ``most_grams`` most frequent are kept.
    """
    words: dict[str, Counter] = {}
    for text, lang in zip(texts, langs, strict=True):
        words.setdefault(lang, Counter()).update(text.split())
    weights, letters = Counter(), Counter()
    for lang, found in words.items():
        for token, n in found.items():
            word = letters_of(token)
            if word:
                for g in grams(word):
                    weights[g, lang] += word_weight(n)
                letters[script_of(word[0]), lang] += n
    totals = Counter()
    for (g, _), w in weights.items():
        totals[g] += w
    kept = {g for g, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:most_grams]}
    return model_of_counts(sorted(words), [(g, lang, w) for (g, lang), w in weights.items() if g in kept], [(s, lang, n) for (s, lang), n in letters.items()], switch_penalty)


def word_weight(n: int) -> int:
    """A word's weight grows with the root of its count: common words must not drown the rest. In millionths."""
    return int(math.sqrt(n) * 1e6)


def model_of_counts(languages: list[str], weights: list[tuple[str, str, int]], letters: list[tuple[str, str, int]], switch_penalty: float) -> LanguageModel:
    """A model from weights of n-grams and words by script, each by language."""
    at = {g: k for k, g in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    by_script: dict[str, np.ndarray] = {}
    for into, found in ((counts, weights), (by_script, letters)):
        for key, lang, n in found:
            if key not in into:
                into[key] = np.zeros(len(languages))
            into[key][at[lang]] += n / 1e6 if into is counts else n
    kept = sorted(counts, key=lambda g: (-counts[g].sum(), g))
    table = np.array([counts[g] for g in kept]) if kept else np.zeros((0, len(languages)))
    smooth = table + 0.5
    scores = np.log(smooth / smooth.sum(0)) if len(kept) else smooth
    scores -= scores.max(1, keepdims=True) if len(kept) else 0
    totals = sum(by_script.values()) if by_script else np.zeros(len(languages))
    scripts = {s: n >= 0.01 * np.maximum(totals, 1) for s, n in by_script.items() if s}
    return LanguageModel(languages, {g: i for i, g in enumerate(kept)}, np.maximum(scores, -_WORST), scripts, switch_penalty)


def _keys(codes: np.ndarray) -> np.ndarray:
    """A number of 63 bits for each run of three code points."""
    c = codes.astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Words(dict):
    """Rows of tokens in a table of scores; rows of tokens not met before are filled by :meth:`fill`."""

    def __init__(self, model: LanguageModel):
        self.model, self.k = model, len(model.languages)
        self.scores, self.weight = np.zeros((4096, self.k)), np.zeros(4096, np.int64)
        self.pending: list[str] = []
        # row 0 stands for n-grams not learned, and so does the key after the last
        self.grams = np.concatenate([np.zeros((1, self.k)), model.gram_scores])
        keys = _keys(_codes("".join(model.gram_rows)))[::3]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(1 << 63))
        self.rows = np.append(np.array(list(model.gram_rows.values()), np.int64)[order] + 1, 0)
        names = sorted({s for _, s in SCRIPT_RANGES})
        self.script_at = np.array([names.index(s) for _, s in SCRIPT_RANGES])
        self.allowed = np.ones((len(names), self.k), bool)
        for s, languages in model.scripts.items():
            if languages.any():
                self.allowed[names.index(s)] = languages

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.pending.append(letters_of(token))
        return at

    def _found(self, codes: np.ndarray) -> np.ndarray:
        """Scores of each run of three code points, 0 for those not learned."""
        keys, back = np.unique(_keys(codes), return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        return self.grams[np.where(self.keys[at] == keys, self.rows[at], 0)[back]]

    def fill(self) -> None:
        """Scores of the tokens met since the last call, all at once."""
        if not self.pending:
            return
        end = len(self)
        while end > len(self.weight):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)])
        lengths = np.array([len(w) for w in self.pending], np.int64)
        codes = _codes("<" + "><".join(self.pending) + ">")
        starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 2)))
        found = self._found(codes) if len(codes) > 2 else np.zeros((0, self.k))
        # the runs that begin at a word's last letter or at its end reach into the next word
        ends = starts + lengths
        found[np.concatenate((ends[ends < len(found)], ends[ends + 1 < len(found)] + 1))] = 0
        score = np.add.reduceat(found, np.minimum(starts, max(len(found) - 1, 0)), axis=0) if len(found) else np.zeros((len(lengths), self.k))
        script = self.script_at[np.searchsorted(_STARTS, codes[starts + 1], "right") - 1]
        score = np.where(self.allowed[script], score, score.min(1, keepdims=True, initial=0.0) - _WORST)
        score = np.maximum(score - score.max(1, keepdims=True, initial=-np.inf), -_WORST)
        score[lengths == 0] = 0
        at = slice(end - len(lengths), end)
        self.scores[at], self.weight[at] = score, lengths
        self.pending.clear()

    def clear(self) -> None:
        super().clear()
        self.pending.clear()


class Labeller:
    """Labels texts with one model; scores of words met are kept."""

    def __init__(self, model: LanguageModel, most_kept: int = 65_000):
        self.model, self.most_kept = model, most_kept
        self.words = _Words(model)

    def label_all(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """Language, confidence from 0 to 1, and spans (language, first word, end) of each text."""
        words = self.words
        for lo in range(0, len(texts), 128):
            if len(words) > self.most_kept:
                words.clear()
            rows = [np.array(list(map(words.__getitem__, (t or "").split())), np.int64) for t in texts[lo : lo + 128]]
            words.fill()
            yield from map(self._label, rows)

    def _label(self, rows: np.ndarray) -> tuple[str, float, list[tuple[str, int, int]]]:
        weight = self.words.weight[rows]
        if not self.model.languages or not weight.any():
            return UNDETERMINED, 0.0, []
        scores = self.words.scores[rows]
        path = self._path(scores)
        if path is None:
            total = scores.sum(0)
            best, share, spans = int(total.argmax()), 1.0, None
            margin = total
        else:
            held = np.bincount(path, weight, len(self.model.languages))
            best = int(np.argmax(held))
            margin, share = scores[path == best].sum(0), held[best] / held.sum()
            cuts = np.flatnonzero(np.diff(path)) + 1
            ends = [0, *cuts.tolist(), len(path)]
            spans = [(self.model.languages[path[a]], a, b) for a, b in zip(ends, ends[1:], strict=False)]
        rivals = margin.tolist()
        own = rivals.pop(best)
        score = float(share / (1 + math.exp(min(max(rivals) - own, 50.0)))) if rivals else float(share)
        return self.model.languages[best], score, spans or [(self.model.languages[best], 0, len(rows))]

    def _path(self, s: np.ndarray) -> np.ndarray | None:
        """Viterbi labels of words with scores ``s``; None for one language throughout.

        One language throughout is the best path if no run of words gains as
        much as one switch costs in any other language, nor do all words in the
        best of the others; else all steps are done.
        """
        n, k = s.shape
        one = int(np.argmax(s.sum(0)))
        gain, over = np.zeros((n + 1, k)), s - s[:, one : one + 1]
        np.cumsum(over, axis=0, out=gain[1:])
        penalty = self.model.switch_penalty
        if (gain - np.minimum.accumulate(gain, axis=0)).max() < penalty:
            over[:, one] = -np.inf
            if over.max(1).sum() < penalty:
                return None
        rows = s.tolist()
        best, came = rows[0], []
        for row in rows[1:]:
            top = max(best)
            floor = top - penalty
            if min(best) >= floor:
                came.append(None)
                best = [x + y for x, y in zip(best, row, strict=True)]
            else:
                came.append((best.index(top), [x < floor for x in best]))
                best = [(x if x >= floor else floor) + y for x, y in zip(best, row, strict=True)]
        at = best.index(max(best))
        path = np.empty(n, np.int64)
        path[-1] = at
        for t in range(n - 2, -1, -1):
            step = came[t]
            if step is not None and step[1][at]:
                at = step[0]
            path[t] = at
        return path


def learn_languages(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 3000, switch_penalty: float = 10.0, most_grams: int = 100_000) -> LanguageModel:
    """Fits a model on ``sample_docs`` at most of the rows that have text and language and satisfy ``may_learn``.

    The rows are chosen by a hash of id, language and text; equal rows count
    once, and rows without an id are not taken. Words and n-grams are counted by
    the executors: what reaches the driver is the weights of ``most_grams``
    n-grams, and one number for each script, by language.
    """
    rows = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # keys are chosen before texts are sorted
    keys = bounded_rows(rows.select(F.xxhash64("id", "lang", "text").alias("key")), sample_docs, "key")
    taken = [r.key for r in keys.collect()]
    sample = rows.withColumn("key", F.xxhash64("id", "lang", "text")).filter(F.col("key").isin(taken)).dropDuplicates(["key"]).select("lang", "text")

    counted = sample.mapInArrow(_counting, "lang string, token string, word string, script string, n long")
    counted = stored(counted.groupBy("lang", "token", "word", "script").agg(F.sum("n").alias("n")), "words")
    ends = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    runs = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(ends, i, F.lit(3)))
    weight = F.floor(F.sqrt("n") * 1e6).cast("long")
    weights = stored(counted.filter("word <> ''").select("lang", weight.alias("w"), F.explode(runs).alias("gram")).groupBy("gram", "lang").agg(F.sum("w").alias("w")), "grams")
    most = weights.groupBy("gram").agg(F.sum("w").alias("all")).orderBy(F.desc("all"), "gram").limit(most_grams).select("gram")
    got = weights.join(most, "gram", "left_semi").select("gram", "lang", "w").collect()
    letters = counted.filter("word <> ''").groupBy("script", "lang").agg(F.sum("n").alias("n")).select("script", "lang", "n").collect()
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    discard(counted, weights)
    return model_of_counts(languages, [tuple(r) for r in got], [tuple(r) for r in letters], switch_penalty)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, text`` to counts of the tokens of each; a text without any is one empty token."""
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            found = Counter(text.as_py().split()) or {"": 0}
            words = [letters_of(t) for t in found]
            columns = [pa.array([lang.as_py()] * len(found)), pa.array(list(found)), pa.array(words), pa.array([script_of(w[0]) if w else "" for w in words]), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "token", "word", "script", "n"])


SPANS = "array<struct<lang: string, first_word: int, end_word: int>>"


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Adds language, score and spans to every row, from the whole text alone.

    Returns the frame, with the columns ``keep`` (default: all), and the names
    of the columns added: ``lang_pred, score, spans``, with underscores in front
    where ``docs`` has such a column. A text that is null or has no letter is
    ``und`` with score 0 and no spans; words are counted as white space cuts them.
    Texts alone go to Python, 128 at a time; all else stays in the JVM.
    """
    keep = docs.columns if keep is None else keep
    names = {n: fresh_name(n, keep) for n in ("lang_pred", "score", "spans")}
    label = fresh_name("label_", [*keep, *names.values()])
    texts_to_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def label_all(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for texts in columns:
            parts = [pa.array([], kind)]
            for lo in range(0, len(texts), 128):
                found = labeller.label_all(texts.slice(lo, 128).to_pylist())
                parts.append(pa.array([{"lang": g, "score": x, "spans": [{"lang": h, "first_word": i, "end_word": j} for h, i, j in s]} for g, x, s in found], kind))
            yield pa.concat_arrays(parts)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(label_all)(columns)

    # not to be worked out again where a filter on the result is pushed down
    predict = F.arrow_udf(run, f"lang string, score double, spans {SPANS}").asNondeterministic()
    source = docs.select(*[F.col(f"`{c}`") for c in keep], predict(F.col(f"`{text_col}`")).alias(label))
    added = [F.col(f"`{label}`.{part}").alias(names[n]) for n, part in (("lang_pred", "lang"), ("score", "score"), ("spans", "spans"))]
    return source.select(*[F.col(f"`{c}`") for c in keep], *added), names
