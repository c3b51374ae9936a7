"""Language identification by interpolated Kneser-Ney character models, one for each language.

Words (runs of letters, lower-cased) are padded and cut into character n-grams up to `ORDER`. Each language's model is
interpolated Kneser-Ney: highest-order counts are discounted, lower orders count distinct left contexts. The n-grams of an
order stand in one sorted array of hashes with a column of probabilities for each language, and so do the contexts with
their back-off weights, so a binary search finds both for all languages. The language of lowest cross-entropy per
character wins; ties go to the first name in order. Rejection is calibrated on training rows set aside from the counts:
a text is rejected if its cross-entropy is above the `REJECT` quantile of theirs, and the temperature of the score is the
one that makes their labels likeliest.

The fit reads at most `max_rows` rows of each language that are not held out, chosen by a hash of the identifier; a repeated
identifier is one row. Predictions read the text alone, whole.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text if nothing could be
learned; rows without lang teach nothing; repeated rows are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import held_out
from .words import Prefix, mix, slices, text_bytes

ORDER = 4
#: Training rows of each language, at most; one in this many of them is set aside for calibration.
MAX_ROWS, ASIDE = 300, 5
#: Languages that are learned, at most, those of most rows; and characters of a training row, at most. Longer rows teach
#: nothing, so what the driver holds is bounded; predictions read texts of any length.
MAX_LANGUAGES, MAX_CHARS = 200, 20_000
DISCOUNT = 0.75
#: Characters that a model spreads its last probability over.
ALPHABET = 1000
REJECT = 0.995
START, STOP = 1, 2


class Letters:
    """Distinct words of the rows as padded characters, and how often each row has each of them."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts_char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = starts_char[offsets]
        table = np.arange(0x250, dtype=np.uint32)
        letter = np.zeros(0x250, bool)
        for c in range(0x250):
            letter[c] = chr(c).isalpha()
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
        rare = np.flatnonzero(chars >= 0x250)
        inside = letter[np.minimum(chars, 0x24F)]
        lower = table[np.minimum(chars, 0x24F)]
        if len(rare):
            every, where = np.unique(chars[rare], return_inverse=True)
            inside[rare] = np.array([chr(c).isalpha() for c in every.tolist()])[where]
            lower[rare] = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in every.tolist()], np.uint32)[where]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        before[bounds[:-1][bounds[:-1] < len(inside)]] = False
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(starts, bounds)
        self.n_words = np.diff(first)
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        hashes = Prefix(lower).hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        _, at, where = np.unique(hashes, return_index=True, return_inverse=True)
        self.row, self.word = row, where
        size = ends[at] - starts[at]
        self.size = size + 1  # each character and the end are predicted
        padded = size + 2
        stop = np.cumsum(padded)
        self.begin = stop - padded
        chars = np.full(int(padded.sum()), STOP, np.uint32)
        chars[self.begin] = START
        into = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        chars[np.repeat(self.begin + 1, size) + into] = lower[np.repeat(starts[at], size) + into]
        self.prefix = Prefix(chars)
        # Every predicted place, its word, and the length of the context that the word gives it.
        self.of = np.repeat(np.arange(len(size)), self.size)
        self.depth = np.arange(len(self.of)) - np.repeat(np.cumsum(self.size) - self.size, self.size) + 1
        self.place = self.begin[self.of] + self.depth

    def grams(self, order: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hash) of the n-grams of this order that end at these places and fit in their word."""
        among = among[self.depth[among] >= order - 1]
        end = self.place[among] + 1
        return among, mix(self.prefix.hash(end - order, end) + np.uint64(order))

    def contexts(self, order: int, among: np.ndarray) -> np.ndarray:
        """Hashes of the order - 1 characters before these places."""
        end = self.place[among]
        return mix(self.prefix.hash(end - (order - 1), end) + np.uint64(order - 1 + 100))


@dataclass
class Model:
    langs: list[str]
    grams: dict = field(default_factory=dict)  # order -> (sorted hashes, log probability of each language)
    contexts: dict = field(default_factory=dict)  # order -> (sorted hashes, log back-off of each language)
    unknown: np.ndarray | None = None  # log probability of a character that no language has, for each of them
    temperature: float = 1.0
    limit: float = np.inf

    def entropy(self, text: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages) cross-entropy per predicted character, and predicted characters of each row."""
        n, k = len(text.n_words), len(self.langs)
        total = np.zeros((len(text.of), k), np.float32)
        todo = np.arange(len(text.of))
        for order in range(ORDER, 1, -1):
            among, keys = text.grams(order, todo)
            hashes, logs = self.grams[order]
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            known = hashes[at] == keys
            total[among[known]] += logs[at[known]]
            missing = among[~known]
            hashes, logs = self.contexts[order]
            keys = text.contexts(order, missing)
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            known_context = hashes[at] == keys
            total[missing[known_context]] += logs[at[known_context]]
            done = np.zeros(len(text.of), bool)
            done[among[known]] = True
            todo = todo[~done[todo]]
        among, keys = text.grams(1, todo)
        hashes, logs = self.grams[1]
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        known = hashes[at] == keys
        total[among[known]] += logs[at[known]]
        total[among[~known]] += self.unknown
        per_word = np.add.reduceat(total, np.cumsum(text.size) - text.size) if len(text.size) else np.zeros((0, k))
        chars = np.bincount(text.row, weights=text.size[text.word], minlength=n)
        sums = np.stack([np.bincount(text.row, weights=per_word[text.word, j].astype(float), minlength=n) for j in range(k)], 1) if n else np.zeros((0, k))
        return -sums / np.maximum(chars, 1)[:, None], chars


def fit_texts(texts: dict[str, list[str]]) -> Model:
    langs = sorted(texts)
    model, counts = Model(langs), {}
    aside = [(j, t) for j, lang in enumerate(langs) for t in texts[lang][:: ASIDE] if len(texts[lang]) > ASIDE]
    for lang in langs:
        own = [t for i, t in enumerate(texts[lang]) if i % ASIDE or len(texts[lang]) <= ASIDE]
        letters = Letters(pa.array(own, pa.string()))
        often = np.bincount(letters.word, minlength=len(letters.size))
        counts[lang] = _counts(letters, often)
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([counts[lang][order][0] for lang in langs]))
        model.grams[order] = keys, np.zeros((len(keys), len(langs)), np.float32)
        if order > 1:
            ctx = np.unique(np.concatenate([counts[lang][order][3] for lang in langs]))
            model.contexts[order] = ctx, np.zeros((len(ctx), len(langs)), np.float32)
    # The n-gram of the next lower order, and the context, of each n-gram of the union.
    union: dict[int, tuple] = {}
    for order in range(1, ORDER + 1):
        everything = [np.stack([counts[lang][order][0], counts[lang][order][2], counts[lang][order][4]]) for lang in langs]
        both = np.concatenate(everything, 1)
        _, at = np.unique(both[0], return_index=True)
        union[order] = both[1][at], both[2][at]
    model.unknown = np.zeros(len(langs), np.float32)
    for j, lang in enumerate(langs):
        lower = None
        for order in range(1, ORDER + 1):
            keys = model.grams[order][0]
            own, n, _, ctx_keys, _, ctx_total, ctx_kinds = counts[lang][order]
            full = np.zeros(len(keys))
            full[np.searchsorted(keys, own)] = n
            if order == 1:
                p = (np.maximum(full - DISCOUNT, 0) + DISCOUNT * len(own) / ALPHABET) / max(1.0, full.sum())
                least = 0.1 / ALPHABET / max(1.0, full.sum())
                p = np.maximum(p, least)
                model.unknown[j] = np.log(max(DISCOUNT * len(own) / ALPHABET / max(1.0, full.sum()), least))
            else:
                lower_key, ctx = union[order]
                all_ctx = model.contexts[order][0]
                total, kinds = np.zeros(len(all_ctx)), np.zeros(len(all_ctx))
                at = np.searchsorted(all_ctx, ctx_keys)
                total[at], kinds[at] = ctx_total, ctx_kinds
                back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                model.contexts[order][1][:, j] = np.log(back)
                at = np.searchsorted(all_ctx, ctx)
                below = lower[np.searchsorted(model.grams[order - 1][0], lower_key)]
                p = np.maximum(full - DISCOUNT, 0) / np.maximum(total[at], 1) + back[at] * below
            lower = p
            model.grams[order][1][:, j] = np.log(p)
    if aside:
        entropy, chars = model.entropy(Letters(pa.array([t for _, t in aside], pa.string())))
        truth = np.array([j for j, _ in aside])
        some = chars > 0
        if some.any():
            entropy, truth = entropy[some], truth[some]
            model.limit = float(np.quantile(entropy.min(1), REJECT))
            def loss(t):
                z = -entropy * t
                z -= z.max(1, keepdims=True)
                return -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean()
            model.temperature = min((0.5 * 2**i for i in range(8)), key=loss)
    return model


def _counts(letters: Letters, often: np.ndarray) -> dict[int, tuple]:
    """order -> (n-grams, count, their lower n-gram, contexts, context of each n-gram, contexts' totals, contexts' kinds)."""
    every = np.arange(len(letters.of))
    weight = often[letters.of].astype(float)
    out: dict[int, tuple] = {}
    for order in range(ORDER, 0, -1):
        among, keys = letters.grams(order, every)
        own, at, where = np.unique(keys, return_index=True, return_inverse=True)
        if order == ORDER:
            n = np.bincount(where, weights=weight[among], minlength=len(own))
        else:
            # Distinct left neighbours; n-grams that begin a word have none and keep their counts.
            n = np.zeros(len(own))
            above_lower = out[order + 1][2]
            n += np.bincount(np.searchsorted(own, above_lower), minlength=len(own))
            begins = letters.depth[among] == order - 1
            n += np.bincount(where[begins], weights=weight[among[begins]], minlength=len(own)) * (n == 0)
        if order > 1:
            lower = letters.grams(order - 1, among[at])[1]
            ctx = letters.contexts(order, among[at])
        else:
            lower = ctx = np.zeros(len(own), np.uint64)
        ctx_keys, ctx_where = np.unique(ctx, return_inverse=True)
        totals = np.bincount(ctx_where, weights=n, minlength=len(ctx_keys))
        kinds = np.bincount(ctx_where, minlength=len(ctx_keys)).astype(float)
        out[order] = own, n, lower, ctx_keys, ctx, totals, kinds
    return out


def training_rows(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(lang, k, text): at most max_rows rows of each language, in the order of k; none that are held out."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    rows = docs.select("doc_id", "lang", "text").where(usable & (F.length("text") <= MAX_CHARS))
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("of")).withColumnRenamed("doc_id", "id")
    often = ids.groupBy(F.col("of").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).select("lang")
    ranked = ids.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= max_rows)
    chosen = ranked.join(F.broadcast(often), ranked.of == often.lang, "left_semi")
    picked = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))  # max_rows of MAX_LANGUAGES
    return picked.groupBy("lang", "k").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Learn from the training rows; None if there are none."""
    got: dict[str, list[str]] = {}
    for r in training_rows(docs, max_rows).toLocalIterator():
        got.setdefault(r.lang, []).append((r.k, r.text))
    got = {lang: [t for _, t in sorted(found)] for lang, found in got.items()}
    return fit_texts(got) if got else None


def identified(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected, cross_entropy."""
    id_type = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the n-grams of max_rows texts a language

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                text, n = Letters(part.column("text")), part.num_rows
                lang, score, entropy = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if m is not None:
                    found, chars = m.entropy(text)
                    best = found.argmin(1)
                    z = -found * m.temperature
                    z = np.exp(z - z.max(1, keepdims=True))
                    some = chars > 0
                    lang[some] = np.array(m.langs, object)[best[some]]
                    score[some] = (z.max(1) / z.sum(1))[some]
                    entropy[some] = found[np.arange(n), best][some]
                rejected = (lang == "und") | (entropy > (m.limit if m is not None else 0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected.astype(bool)), pa.array(entropy)], ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])

    out = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean, cross_entropy double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
