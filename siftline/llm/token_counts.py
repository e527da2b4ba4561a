"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A leaf holds the code points and tokens of one pre-token, inner nodes hold sums.  An edit
descends to the leaves it touches, splits and encodes again only the text from the last
stable leaf before them to the first old boundary the new split falls back onto, and
updates the sums above those leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.bpe import load_ranks

#: Words whose counts a task keeps; beyond it the cache starts afresh.
CACHE_WORDS = 500_000
#: Leaves read after an edit at first; doubled until the split falls back onto an old boundary.
LOOK_AHEAD = 8
#: Code points before an edit that are split again at least.
CONTEXT = 3


class PieceCounter:
    """Splits texts into pre-tokens and counts the tokens of each, once per word in the cache."""

    def __init__(self, path: str, pattern: str, most: int = CACHE_WORDS):
        compiled = regex.compile(pattern)
        self.split, self.split_iter, self.most = compiled.findall, compiled.finditer, most
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.encode(word))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = n
        return n

    def counts(self, words: list[str]) -> list[int]:
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.count(w) if n is None else n for w, n in zip(words, found)]
        return found


class PieceTree:
    """Segment tree of one document; positions are code points."""

    def __init__(self, coder: PieceCounter, text: str, lengths, tokens):
        self.coder, self.text = coder, text
        self.n = len(lengths)
        self.cap = 1 << max(0, self.n - 1).bit_length()
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.chars, self.tokens = self._tree(lengths), self._tree(tokens)
        self.changed: dict[int, list[str]] = {}
        self.encoded_again = 0

    def _tree(self, leaves) -> np.ndarray:
        sums = np.zeros(2 * self.cap, np.int64)
        sums[self.cap:self.cap + self.n] = leaves
        self._sum_up(sums, self.cap, 2 * self.cap - 1)
        return sums

    @staticmethod
    def _sum_up(sums: np.ndarray, low: int, high: int) -> None:
        while low > 1:
            low, high = low // 2, high // 2
            sums[low:high + 1] = sums[2 * low:2 * high + 2:2] + sums[2 * low + 1:2 * high + 2:2]

    def leaf(self, i: int) -> str:
        pieces = self.changed.get(i)
        return self.text[self.starts[i]:self.starts[i + 1]] if pieces is None else "".join(pieces)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds position ``at`` and the offset in it; (n, 0) at the end."""
        if at >= self.chars[1]:
            return self.n, 0
        node = 1
        while node < self.cap:
            node *= 2
            if at >= self.chars[node]:
                at -= int(self.chars[node])
                node += 1
        return node - self.cap, at

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` code points from ``at`` by ``put``; positions beyond the text are moved to its end."""
        total = int(self.chars[1])
        at = min(max(at, 0), total)
        cut = min(max(cut, 0), total - at)
        a, head = self.find(at)
        b, tail = self.find(at + cut)
        # the split before a leaf is settled by the text up to its first other character than
        # white space, and by two more characters where a contraction may begin
        first, context = a, ""
        while first > 0 and (len(context) < CONTEXT or context.isspace()):
            first -= 1
            context = self.leaf(first) + context
        before = context + (self.leaf(a)[:head] if head else "") + put
        # the rest starts inside leaf b, or at its start, where an old boundary is
        window, ends = before, {len(before): b} if not tail else {}
        upto = b
        if tail:
            window += self.leaf(b)[tail:]
            upto = b + 1
            ends[len(window)] = upto
        pieces, done, ahead, stop = [], 0, LOOK_AHEAD, None
        while stop is None:
            while upto < self.n and ahead:
                window += self.leaf(upto)
                upto, ahead = upto + 1, ahead - 1
                ends[len(window)] = upto
            last = upto >= self.n
            if done == len(window) and last:
                stop = self.n
                break
            if done >= len(before) and done in ends:
                stop = ends[done]
                break
            for match in self.coder.split_iter(window, done):
                if match.end() == len(window) and not last:
                    break
                pieces.append(match.group())
                done = match.end()
                if done >= len(before) and done in ends:
                    stop = ends[done]
                    break
            ahead = max(LOOK_AHEAD, upto - b)
        self._put(first, stop, pieces)

    def _put(self, first: int, stop: int, pieces: list[str]) -> None:
        """Hang the new pieces on leaf ``first`` and empty the other leaves up to ``stop``."""
        if first >= self.n:
            if not pieces:
                return
            self.n = first + 1  # the tree was empty
            self.starts = np.zeros(2, np.int64)
        elif stop == first:  # pure insertion before a leaf that stays
            pieces = pieces + self.changed.get(first, [self.leaf(first)])
        stop = max(stop, first + 1)
        for i in range(first, stop):
            self.changed[i] = []
        self.changed[first] = pieces
        low, high = self.cap + first, self.cap + stop - 1
        for sums, value in ((self.chars, sum(map(len, pieces))), (self.tokens, sum(self.coder.counts(pieces)))):
            sums[low:high + 1] = 0
            sums[low] = value
            self._sum_up(sums, low, high)
        self.encoded_again += int(self.chars[low])

    def state(self) -> tuple[str, list[int], list[int]]:
        """Text, and code points and tokens of its pre-tokens, after all edits."""
        if not self.changed:
            return self.text, self.chars[self.cap:self.cap + self.n].tolist(), self.tokens[self.cap:self.cap + self.n].tolist()
        texts, lengths, tokens = [], [], []
        done = 0
        for i in sorted(self.changed):
            texts.append(self.text[self.starts[done]:self.starts[i]])
            lengths += self.chars[self.cap + done:self.cap + i].tolist()
            tokens += self.tokens[self.cap + done:self.cap + i].tolist()
            texts += self.changed[i]
            lengths += map(len, self.changed[i])
            tokens += self.coder.counts(self.changed[i])
            done = i + 1
        texts.append(self.text[self.starts[done]:])
        lengths += self.chars[self.cap + done:self.cap + self.n].tolist()
        tokens += self.tokens[self.cap + done:self.cap + self.n].tolist()
        return "".join(texts), lengths, tokens


TREE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lengths", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
TREE_SQL = "doc_id bigint, text string, lengths array<int>, tokens array<int>"


def build_trees(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, lengths, tokens) of every document: the leaves of its tree.

    Null texts count as empty and have no leaves.  Columns in ``keep`` pass through.
    """
    kept = [F.col(k) for k in keep]
    schema = TREE_SQL + "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCounter(path, pattern)
        for batch in batches:
            lengths, tokens = [], []
            for value in batch.column("text"):
                words = coder.split(value.as_py())
                lengths.append(np.fromiter(map(len, words), np.int32, len(words)))
                tokens.append(np.array(coder.counts(words), np.int32))
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(lengths, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(k) for k in keep], names=[*TREE.names, *keep])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *kept)
    return rows.mapInArrow(build, schema)


def edit_trees(trees: DataFrame, path: str, pattern: str, edits: str = "edits", with_state: bool = False) -> DataFrame:
    """Apply to each tree its ``edits``, an array of struct(at, cut, put), in order.

    Returns doc_id, n_edits, n_tokens_before, n_tokens_after, n_chars_after and
    n_encoded_again (code points encoded anew); ``with_state`` adds the new text, lengths
    and tokens.  A null or empty array changes nothing; null parts of an edit count as
    0 or as empty.
    """
    counts = ["n_edits", "n_tokens_before", "n_tokens_after", "n_chars_after", "n_encoded_again"]
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", text string, lengths array<int>, tokens array<int>" * with_state

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCounter(path, pattern)
        for batch in batches:
            rows: list[list[int]] = []
            states = []
            lengths, tokens = batch.column("lengths"), batch.column("tokens")
            for i, (value, todo) in enumerate(zip(batch.column("text"), batch.column("edits"))):
                tree = PieceTree(coder, value.as_py(), lengths[i].values.to_numpy(), tokens[i].values.to_numpy())
                before, steps = int(tree.tokens[1]), todo.as_py() or []
                for e in steps:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                rows.append([len(steps), before, int(tree.tokens[1]), int(tree.chars[1]), tree.encoded_again])
                if with_state:
                    states.append(tree.state())
            columns = [batch.column("doc_id")] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(counts))]
            if with_state:
                columns += [pa.array([s[k] for s in states], t) for k, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, *TREE.names[1:] * with_state])

    return trees.select("doc_id", "text", "lengths", "tokens", F.col(edits).alias("edits")).mapInArrow(apply, schema)


def sample_edits(text: Column, doc_id: Column) -> Column:
    """Three edits of a text that follow from its id: a copied passage, a cut and a word put in."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    spot = lambda k, most: F.pmod(F.xxhash64(doc_id, F.lit(k)), most).cast("int")
    edit = lambda at, cut, put: F.struct(at.alias("at"), cut.cast("int").alias("cut"), put.alias("put"))
    return F.array(
        edit(spot(1, n + 1), F.lit(0), F.substring(text, spot(2, n + 1) + 1, F.lit(40))),
        edit(spot(3, n + 1), spot(4, F.lit(30)), F.lit("")),
        edit(spot(5, n + 1), spot(6, F.lit(5)), F.concat(F.lit(" edit"), spot(7, F.lit(1000)).cast("string"))),
    )
