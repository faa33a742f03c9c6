"""Edit-aware token counts: a balanced segment tree of pre-token runs per document.

A document's leaves are runs of whole pre-tokens of about LEAF_CHARS characters; a node
holds the characters and tokens below it. Since tokens never cross pre-tokens, counts of
leaves add up exactly, in any script. An edit finds its place by descending on
characters, and starts anew at the last leaf that ends far enough before it
that the pre-tokeniser can't have seen the edit. From there text is cut into pre-tokens
until a cut falls on an old leaf's end behind the edit: what follows is as it was. Only
this stretch is counted again. Its leaves replace the old ones by splitting and joining the
tree, which costs the logarithm of its leaves, however many an edit adds or takes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import pieces

LEAF_CHARS = 512
#: Characters behind a pre-token that the pattern may look at to end it there ("'re" and what comes after white space); patterns that look back are not for this operator.
REACH = 3
#: Pre-tokens whose counts a worker remembers.
KNOWN = 400_000

Edit = tuple[int, int, str]  # from, to, replacement


class Counter(dict):
    """Counts the tokens of pre-tokens with the ranks in the file at path; pattern says what a pre-token is. Remembers what it has counted."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding._encode_single_piece(piece))
        if len(self) >= KNOWN:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n

    def whole(self, text: str) -> int:
        """The tokens of a text, by the tokenizer itself."""
        return len(self.encoding.encode_ordinary(text))


class _Node:
    """A leaf with text, or an inner node; never changed once made."""

    __slots__ = ("chars", "height", "left", "leaves", "right", "text", "tokens")

    def __init__(self, left: _Node | None, right: _Node | None, text: str = "", tokens: int = 0):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.height, self.chars, self.tokens, self.leaves = 0, len(text), tokens, 1
        else:
            self.height = max(left.height, right.height) + 1
            self.chars, self.tokens, self.leaves = left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves


def _balanced(a: _Node, b: _Node) -> _Node:
    """A node over a and b, whose heights differ by two at most."""
    if b.height > a.height + 1:
        if b.left.height <= b.right.height:
            return _Node(_Node(a, b.left), b.right)
        return _Node(_Node(a, b.left.left), _Node(b.left.right, b.right))
    if a.height > b.height + 1:
        if a.right.height <= a.left.height:
            return _Node(a.left, _Node(a.right, b))
        return _Node(_Node(a.left, a.right.left), _Node(a.right.right, b))
    return _Node(a, b)


def _join(a: _Node | None, b: _Node | None) -> _Node | None:
    """The tree of a's leaves and then b's; the work is the difference of their heights."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _balanced(a.left, _join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(_join(a, b.left), b.right)
    return _Node(a, b)


def _split(t: _Node | None, at: int) -> tuple[_Node | None, _Node | None]:
    """The leaves before and from character `at`, which lies between leaves."""
    if t is None or at <= 0:
        return None, t
    if at >= t.chars:
        return t, None
    if at <= t.left.chars:
        a, b = _split(t.left, at)
        return a, _join(b, t.right)
    a, b = _split(t.right, at - t.left.chars)
    return _join(t.left, a), b


def _plant(leaves: list[_Node]) -> _Node | None:
    """A balanced tree over leaves."""
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return _Node(_plant(leaves[:half]), _plant(leaves[half:]))


class CountTree:
    """The tree of one document. counted is how many characters have been counted since it was made."""

    def __init__(self, text: str, counter: Counter, leaf: int = LEAF_CHARS):
        self.counter, self.leaf, self.counted = counter, leaf, 0
        found = counter.pattern.findall(text) if not counter.pattern.groups else []
        if sum(map(len, found)) != len(text):
            found = self._pieces(text)
        self.root = _plant(self._leaves(found))

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens; the pattern must pass nothing over."""
        found = [m.group() for m in self.counter.pattern.finditer(text)]
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern leaves characters out")
        return found

    def _leaves(self, found: list[str]) -> list[_Node]:
        """Leaves of whole pre-tokens."""
        out, own, chars, counter = [], [], 0, self.counter
        for p in found:
            own.append(p)
            chars += len(p)
            if chars >= self.leaf:
                out.append(_Node(None, None, "".join(own), sum([counter[x] for x in own])))
                own, chars = [], 0
        if own:
            out.append(_Node(None, None, "".join(own), sum([counter[x] for x in own])))
        self.counted += sum(x.chars for x in out)
        return out

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def n_leaves(self) -> int:
        return self.root.leaves if self.root else 0

    def __str__(self) -> str:
        out, todo = [], [self.root] if self.root else []
        while todo:
            t = todo.pop()
            if t.left is None:
                out.append(t.text)
            else:
                todo += [t.right, t.left]
        return "".join(out)

    def _find(self, at: int) -> tuple[int, str]:
        """Where the leaf that holds character `at` starts, and its text; nothing at the end."""
        t, start = self.root, 0
        if t is None or at >= t.chars:
            return self.n_chars, ""
        while t.left is not None:
            if at < start + t.left.chars:
                t = t.left
            else:
                start, t = start + t.left.chars, t.right
        return start, t.text

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start to stop. Places beyond the text mean its end; stop before start means start."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        if start == stop and not new:
            return
        first = self._find(max(0, start - REACH))[0] if self.root else 0
        before, at = [], first
        while at < start:
            _, leaf = self._find(at)
            before.append(leaf[: start - at])
            at += len(leaf)
        own, tail = self._find(stop)
        old = own + len(tail)  # the old text is read up to here
        text = "".join(before) + new + tail[stop - own :]
        ends = [len(text)]  # where old leaves end, in text
        found, at = [], 0
        while True:
            m = self.counter.pattern.search(text, at)
            if (m is None or m.end() + REACH > len(text)) and old < self.n_chars:
                _, leaf = self._find(old)  # the pattern may see what comes next
                text, old = text + leaf, old + len(leaf)
                ends.append(len(text))
                continue
            to = m.end() if m else len(text)
            if to > at:
                found.append(text[at:to])
            at = to
            if at in ends or at >= len(text):
                break
        left, rest = _split(self.root, first)
        _, right = _split(rest, old - (len(text) - at) - first)
        self.root = _join(_join(left, _plant(self._leaves(found))), right)


def edited_counts(docs: DataFrame, path: str, pattern: str, edits: Callable[[str], list[Edit]] | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_chars, n_before, n_after, n_edits, n_leaves, n_built, n_reencoded) for each row of docs (doc_id, text[, edits]).

    The edits of a document, in order, each placed in the text that the one before
    left, are what the function `edits` makes of its text, or else its column
    edits (array of struct start int, stop int, new string; null: none). n_built and
    n_reencoded are the characters counted for the tree and for the edits; a pre-token, however long, is
    counted whole. A null text counts as empty. Whole texts are
    read; rows are taken one by one, so repeated rows give repeated rows.
    """
    columns = ["doc_id", "text"] + ([] if edits else ["edits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for part in pieces(batches):
            texts = part.column("text").to_pylist()
            listed = None if edits else part.column("edits").to_pylist()
            out = []
            for i, text in enumerate(texts):
                tree = CountTree(text or "", counter, leaf)
                before, built = tree.n_tokens, tree.counted
                todo = edits(text or "") if edits else [(e["start"], e["stop"], e["new"]) for e in listed[i] or []]
                for e in todo:
                    tree.edit(*e)
                out.append((tree.n_chars, before, tree.n_tokens, len(todo), tree.n_leaves, built, tree.counted - built))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(list(c), pa.int64()) for c in zip(*out, strict=True))], names=["doc_id", *names])

    names = ["n_chars", "n_before", "n_after", "n_edits", "n_leaves", "n_built", "n_reencoded"]
    return docs.select(F.col("doc_id").cast("long"), *columns[1:]).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))
