"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import held, table
from .hashing import slices, text_bytes

TRAIN_DOCS, TRAIN_CHARS = 60, 36_000  # of each language, at most
SYMBOLS = 46  # letters that have a column in the automata; transitions by other ones are looked up
SEGMENT = 1024  # symbols that are parsed by themselves at first; what is open at their seams is parsed on (``mend_seams``)
BLOCK_BYTES = 1 << 20


def unicode_letters() -> Iterator[tuple[int, str]]:
    """Code point and lower case of every letter."""
    return ((i, chr(i).lower()) for i in range(0x110000) if chr(i).isalpha())


def automaton(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The transitions of the suffix automaton of a text: a row for each state, -1 where there is none, and
    (state, symbol, next state) for symbols from ``width`` on."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), width), -1, np.int32)
    rare = []
    for i, row in enumerate(nxt):
        for c, j in row.items():
            if c < width:
                out[i, c] = j
            else:
                rare.append((i, c, j))
    return out, np.array(rare, np.int64).reshape(-1, 3)


class CrossParser:
    """Phrase counts of texts against a training text per language.

    A text is read as letters in lower case, anything between letters as one separator. It is parsed from left to right
    into the longest matches with the training text; a letter that no training text has is a phrase of its own.
    """

    def __init__(self, training: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in training]
        seen = Counter(c.lower() for _, t in training for c in t if c.isalpha())
        self.width = SYMBOLS + 2
        # from 1 on the commonest; 0 is the separator and SYMBOLS + 1 a letter that no training text has
        letters = {c: i + 1 if i < SYMBOLS else i + 2 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
        self.symbol = np.zeros(0x110000, np.int32)
        for i, c in unicode_letters():
            self.symbol[i] = letters.get(c, SYMBOLS + 1)
        self.span = len(letters) + 3  # more than any symbol
        keys, values = [], []
        tables, self.root, at = [], [], 0
        # an automaton has at most two states a symbol; the narrower numbers are chosen before it is built, as wide ones take the most memory here
        self.kind = np.int32 if sum(2 * len(t) + 2 for _, t in training) * self.width * 4 < 1 << 31 else np.int64
        for _, t in training:
            move, rare = automaton(self.symbols(np.frombuffer(t.encode("utf-32-le", "replace"), "<u4")), self.width)
            move[:, SYMBOLS + 1] = -1
            move = move.astype(self.kind, copy=False)
            begin = move[0]
            jump = np.where(begin >= 0, begin, 0)
            step = np.where(move >= 0, (move + at) * self.width * 4, (jump + at) * self.width * 4 + 1 + (begin < 0))
            step[0] = (jump + at) * self.width * 4 + (begin < 0)  # at the root no phrase is open
            self.root.append(at * self.width)
            keys.append((rare[:, 0] + at) * self.width * self.span + rare[:, 1])
            values.append((rare[:, 2] + at) * self.width)
            at += len(move)
            tables.append(step)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.rare_keys, self.rare_next = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, values))
        order = np.argsort(self.rare_keys)
        self.rare_keys, self.rare_next = self.rare_keys[order], self.rare_next[order]

    def after_rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where symbols without a column lead to, -1 where there is no transition."""
        key = np.asarray(state, np.int64) * self.span + symbol
        at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == key, self.rare_next[at], -1)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        s = self.symbol[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        return s[keep]

    def parse(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(letters, phrases by language) of each text."""
        n = len(column)
        letters, phrases = np.zeros(n, np.int64), np.zeros((n, len(self.langs)), np.int64)
        parts, owner, size = [], [], []
        for i, t in enumerate(column.to_pylist()):
            s = self.symbols(np.frombuffer((t or "").encode("utf-32-le", "replace"), "<u4"))
            letters[i] = np.count_nonzero(s)
            parts.append(s)
            for lo in range(0, len(s), SEGMENT):
                owner.append(i)
                size.append(min(SEGMENT, len(s) - lo))
        if not owner or not self.langs:
            return letters, phrases
        whole, size, owner = np.concatenate(parts).astype(np.int32), np.array(size), np.array(owner)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")
        whole = np.append(whole, np.zeros(SEGMENT, np.int32))
        grid = np.empty((size[0], len(start)), np.int32)
        for t in range(0, size[0], 64):  # symbol t of every segment, as a row
            grid[t : t + 64] = whole[start[:, None] + np.arange(t, min(t + 64, size[0]))].T
        state = np.repeat(np.array(self.root, self.kind)[:, None], len(start), 1)
        count = np.zeros((len(self.langs), len(start)), np.int32)
        for t in range(size[0]):
            k = active[t]
            row = grid[t, :k]
            odd = np.flatnonzero(row >= self.width) if len(self.rare_keys) else ()
            if len(odd):
                rare = row[odd]
                row[odd] = SYMBOLS + 1
            for lang in range(len(self.langs)):
                v = self.table.take(state[lang, :k] + row)
                if len(odd):
                    old, begin = state[lang, odd], self.after_rare(self.root[lang], rare)
                    on = self.after_rare(old, rare)
                    v[odd] = np.where(on >= 0, on << 2, np.where(begin >= 0, (begin << 2) + 1, v[odd]))
                count[lang, :k] += v & 3
                state[lang, :k] = v >> 2
        back = np.argsort(order)
        state, count, start, size, owner = state[:, back], count[:, back].astype(np.int64), start[back], size[back], owner[back]
        self.mend_seams(whole, start, size, owner, state, count)
        last = np.append(owner[1:] != owner[:-1], True)  # a text's last phrase is open at its end
        count += (state != np.array(self.root, self.kind)[:, None]) & last
        for lang in range(len(self.langs)):
            phrases[:, lang] = np.bincount(owner, count[lang], n)
        return letters, phrases

    def advance(self, state: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and how many phrases end."""
        v = self.table.take(state + np.where(symbol >= self.width, SYMBOLS + 1, symbol))
        odd = np.flatnonzero(symbol >= self.width)
        if len(odd):
            begin, on = self.after_rare(root[odd], symbol[odd]), self.after_rare(state[odd], symbol[odd])
            v[odd] = np.where(on >= 0, on << 2, np.where(begin >= 0, (begin << 2) + 1, v[odd]))
        return v >> 2, v & 3

    def mend_seams(self, whole: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Parse on over the seams between the segments of a text: ``count`` and ``state``, of segments parsed from a fresh
        start, become those of one parse of the whole text.

        A segment is parsed once more from the state that the one before ends in, beside the fresh parse, until both are in
        the same state, which is after a few symbols mostly; from there on they are one. Where they don't meet, the segment
        ends in another state, and the one after it is parsed again with that.
        """
        fresh, alone = state.copy(), count.copy()
        seam = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        lang, seg = (x.ravel() for x in np.meshgrid(np.arange(len(self.langs)), seam, indexing="ij"))
        roots = np.array(self.root, self.kind)
        while len(seg):
            root = roots[lang]
            ours, theirs, more = state[lang, seg - 1], root.copy(), np.zeros(len(seg), np.int64)
            live, t = np.flatnonzero(ours != theirs), 0
            end = fresh[lang, seg]
            while len(live):
                symbol = whole[start[seg[live]] + t]
                a, ended = self.advance(ours[live], symbol, root[live])
                b, ended_fresh = self.advance(theirs[live], symbol, root[live])
                ours[live], theirs[live] = a, b
                more[live] += ended.astype(np.int64) - ended_fresh
                t += 1
                over = t == size[seg[live]]
                end[live[over]] = a[over]
                live = live[(a != b) & ~over]
            count[lang, seg] = alone[lang, seg] + more
            moved = end != state[lang, seg]
            state[lang, seg] = end
            again = moved & (seg + 1 < len(owner))
            again[again] = owner[seg[again] + 1] == owner[seg[again]]
            lang, seg = lang[again], seg[again] + 1

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, phrases for each letter) of each text; ties go to the first language."""
        letters, phrases = self.parse(column)
        if not self.langs:
            return ["und"] * len(letters), np.zeros(len(letters)), np.ones(len(letters))
        ranked = np.sort(phrases, 1)
        second = ranked[:, 1] if len(self.langs) > 1 else letters
        score = np.clip(np.where(letters > 0, 1 - ranked[:, 0] / np.maximum(second, 1), 0), 0, 1)
        best = phrases.argmin(1)
        rate = ranked[:, 0] / np.maximum(letters, 1)
        return [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)], score, rate


def parser(training: tuple[tuple[str, str], ...]) -> CrossParser:
    return held(("parser", training), lambda: CrossParser(training))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def training_texts(docs: DataFrame, label: str) -> tuple[tuple[str, str], ...]:
    """A text per language: at most TRAIN_DOCS documents and TRAIN_CHARS characters, from the labelled rows that aren't held out.

    Documents come in a hashed order, shorter ones first. As some hold passages in another language, lines are kept only
    if the half of the sample that they aren't from puts them into their language too.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & ~held_out())
    keys = rows.select(F.col(label).alias("label"), (~F.length("text").between(400, 6000)).alias("odd"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    first = keys.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("odd", "h", "t"))).where(F.col("rank") <= TRAIN_DOCS)
    # hashes only are ranked; TRAIN_DOCS for each language at most, so that the join is a broadcast one
    chosen = F.broadcast(first.groupBy("label", "h", "t").agg(F.min("rank").alias("rank")))
    texts = rows.select(F.col(label).alias("label"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text").join(chosen, ["label", "h", "t"]).groupBy("label", "h", "t").agg(F.min("rank").alias("rank"), F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text")).collect()
    langs = sorted({r.label for r in texts})
    halves: tuple[list, list] = ([], [])
    for lang in langs:
        texts_of = [r.text for r in sorted((r for r in texts if r.label == lang), key=lambda r: r.rank)]
        for i in (0, 1):
            halves[i].append((lang, "\n".join(texts_of[i::2])[:TRAIN_CHARS]))
    kept = {lang: "" for lang in langs}
    for i in (0, 1):
        judge = CrossParser(tuple(halves[1 - i]))
        for lang, text in halves[i]:
            lines = [x for x in text.split("\n") if x.strip()]
            said = judge.predict(pa.array(lines, pa.string()))[0]
            kept[lang] += "".join(x + "\n" for x, s in zip(lines, said, strict=True) if s == lang)[: TRAIN_CHARS // 2]
    least = min([len(t) for t in kept.values() if len(t) > 2000], default=None)  # texts of one length: phrase counts compare
    whole = {lang: "\n".join(t for h in halves for x, t in h if x == lang) for lang in langs}
    return tuple((lang, (kept[lang] if least and len(kept[lang]) > 2000 else whole[lang])[: least or TRAIN_CHARS]) for lang in langs)


def label_batches(training: tuple[tuple[str, str], ...], text: str, kept: list[str]):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column(text))
            for i, j in slices(at, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                lang, score, rate = parser(training).predict(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], [*kept, "lang_pred", "score", "phrase_rate"])

    return label


def labelled(docs: DataFrame, learn_from: DataFrame, label: str = "lang", text: str = "text", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` of each row of ``docs`` (all, if None), and lang_pred, score, phrase_rate of its ``text``: see
    ``identify``. Rows are told in place, without a shuffle. lang_pred, score and phrase_rate must be no column of ``docs``."""
    kept = docs.columns if kept is None else kept
    schema = StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double").add("phrase_rate", "double")
    return docs.mapInArrow(label_batches(training_texts(learn_from, label), text, kept), schema)


def identify(docs: DataFrame, label: str = "lang", learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate for each row of ``docs`` (integer doc_id, text, and the label to learn from).

    The language whose training text needs the fewest phrases wins; as training texts are of one length, the counts are
    normalised. score is 1 - fewest / second fewest. A null text or one without a letter is ``und`` with score 0. Learnt
    only from rows with a label whose crc32(doc_id) mod 4 is not 2; without any, all is ``und``. Repeated rows, and rows
    without doc_id, are judged like others. ``learn_from`` is a table to learn from in place of ``docs``. An empty table
    gives no row. Texts of any length are parsed whole, phrases running on over the segments that are parsed side by side.
    Other columns are ignored. The sample that goes to the driver and back is
    bounded by TRAIN_DOCS and TRAIN_CHARS for each language; the automata are built where they are used.
    """
    return labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs if learn_from is None else learn_from, label, kept=["doc_id"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")
