"""Edit-aware token counts.

A document is kept as a segment tree whose leaves are runs of whole pre-tokens of about ``LEAF`` characters and whose nodes
hold sums of characters and tokens. Leaves are cut only where the byte-level BPE's pattern always ends a pre-token, whatever
stands around: behind a character that is no space and before a space or line end, and, in scripts that are written without
spaces, between a letter and a mark of punctuation. So leaves can be encoded apart. An edit joins the leaves that it touches,
and a neighbour whose cut it could undo, into one region; only that region is cut and encoded again, the trees on its two
sides are joined to it by height, and the sums above are updated. Trees are rows of a table (the text, and characters and
tokens of its leaves): yesterday's table and today's edits give today's table and counts without encoding the corpus again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from millrace.llm.hashing import slices
from millrace.llm.scratch import materialize, small_batches, tidied
from millrace.llm.tokens import encoder, public_file

LEAF = 256
CUT = regex.compile(
    r"(?<=[\p{L}\p{M}\p{N}\p{P}\p{S}])(?=[ \n\r\t])"
    r"|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\u0e01-\u0e30\u0e81-\u0eb0\u1000-\u102a\u1780-\u17b3])(?=[\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u17b6-\u17d3])"
)
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"
TREE = "doc_id bigint, text string, leaf_chars array<int>, leaf_tokens array<int>, chars bigint, tokens bigint"
EDITED = f"{TREE}, tokens_before bigint, encoded_again bigint"


def leaves_of(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > LEAF:
        found = CUT.search(text, at + LEAF)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Node:
    """A leaf has a text; other nodes have two children, whose heights differ by one at most. chars and tokens are sums over
    the leaves below. Nodes are never changed, so trees may share them."""

    __slots__ = ("text", "left", "right", "chars", "tokens", "height")

    def __init__(self, text: str | None, tokens: int = 0, left: Node | None = None, right: Node | None = None) -> None:
        self.text, self.left, self.right, self.chars, self.tokens, self.height = text, left, right, len(text or ""), tokens, 0
        if left:
            self.chars, self.tokens, self.height = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.height, right.height)


def balanced(left: Node, right: Node) -> Node:
    """One tree of two whose heights differ by two at most."""
    if left.height > right.height + 1:
        if left.left.height < left.right.height:
            return Node(None, 0, Node(None, 0, left.left, left.right.left), Node(None, 0, left.right.right, right))
        return Node(None, 0, left.left, Node(None, 0, left.right, right))
    if right.height > left.height + 1:
        if right.right.height < right.left.height:
            return Node(None, 0, Node(None, 0, left, right.left.left), Node(None, 0, right.left.right, right.right))
        return Node(None, 0, Node(None, 0, left, right.left), right.right)
    return Node(None, 0, left, right)


def joined(left: Node | None, right: Node | None) -> Node | None:
    """One balanced tree with the leaves of both, in steps of the difference of their heights."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return balanced(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return balanced(joined(left, right.left), right.right)
    return Node(None, 0, left, right)


def grown(level: list[Node]) -> Node:
    """A balanced tree over leaves."""
    if len(level) == 1:
        return level[0]
    middle = len(level) // 2
    return Node(None, 0, grown(level[:middle]), grown(level[middle:]))


class CountedText:
    """A text and its tree. Given the leaves of a kept tree, nothing is encoded."""

    def __init__(self, text: str, encode: Callable[[str], list[int]], leaf_chars: list[int] | None = None, leaf_tokens: list[int] | None = None) -> None:
        self.encode, self.encoded_again = encode, 0
        if leaf_chars is None:
            self.root = self.build(text)
        else:
            ends = list(itertools.accumulate(leaf_chars))
            self.root = grown([Node(text[end - n : end], tokens) for end, n, tokens in zip(ends, leaf_chars, leaf_tokens, strict=True)])

    def build(self, text: str) -> Node:
        return grown([Node(x, len(self.encode(x))) for x in leaves_of(text)])

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters start to end - 1; both are first clamped to the text, and end to at least start."""
        start = min(max(start, 0), self.root.chars)
        end = min(max(end, start), self.root.chars)
        # a cut needs the characters on its two sides unchanged
        before, region, at, behind = self.parted(self.root, 0, max(start - 1, 0), min(end + 1, self.root.chars))
        text = "".join(x.text for x in region)
        text = text[: start - at] + replacement + text[end - at :]
        self.encoded_again += len(text)
        middle = self.build(text) if text or not (before or behind) else None
        self.root = joined(joined(before, middle), behind)

    def parted(self, node: Node, base: int, low: int, high: int) -> tuple[Node | None, list[Node], int, Node | None]:
        """The trees before and behind the leaves that touch low to high, these leaves, and where the first of them begins."""
        if base + node.chars < low:
            return node, [], 0, None
        if base > high:
            return None, [], 0, node
        if node.text is not None:
            return None, [node], base, None
        a, b = self.parted(node.left, base, low, high), self.parted(node.right, base + node.left.chars, low, high)
        return joined(a[0], b[0]), a[1] + b[1], a[2] if a[1] else b[2], joined(a[3], b[3])

    def leaves(self) -> list[Node]:
        out, stack = [], [self.root]
        while stack:
            x = stack.pop()
            if x.text is None:
                stack += [x.right, x.left]
            else:
                out.append(x)
        return out

    def text(self) -> str:
        return "".join(x.text for x in self.leaves())


def tree_row(key: int | None, tree: CountedText) -> tuple:
    leaves = tree.leaves()
    return key, "".join(x.text for x in leaves), [len(x.text) for x in leaves], [x.tokens for x in leaves], tree.root.chars, tree.root.tokens


_KINDS = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["doc_id", "text", "leaf_chars", "leaf_tokens", "chars", "tokens", "tokens_before", "encoded_again"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=False)], _NAMES[: len(rows[0])])


def plant(tokenizer: str):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _batch([tree_row(key, CountedText(text or "", encode)) for key, text in zip(*(c.to_pylist() for c in part.columns), strict=True)])

    return run


def change(tokenizer: str):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, text, chars, tokens, edits in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tree = CountedText(text, encode, chars, tokens)
                    before = tree.root.tokens
                    for e in edits or []:
                        if e is not None:
                            start = e["start"] or 0
                            tree.edit(start, start if e["end"] is None else e["end"], e["replacement"] or "")
                    rows.append((*tree_row(key, tree), before, tree.encoded_again))
                yield _batch(rows)

    return run


def token_trees(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tree of every row: doc_id, text, leaf_chars, leaf_tokens, chars, tokens. This encodes whole texts; write the table
    and give it to ``edited_trees`` from then on.

    Null text is empty (one empty leaf, 0 tokens). Repeated rows come out repeated and null ids as null; an empty table gives
    no rows; other columns are not read. An added token's string in a text is that token, as tokenizers has it by default."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(plant(tokenizer or public_file()), TREE)


def edited_trees(trees: DataFrame, tokenizer: str | None = None, edits_col: str = "edits") -> DataFrame:
    """``trees`` is a table of ``token_trees`` or of this function, with a column of edits. The trees after these edits, and
    tokens_before and encoded_again (characters).

    Null edits, or an empty list, change nothing. In an edit a null start is 0, a null end is the start, a null replacement is
    empty; places beyond the text are its end."""
    small_batches(trees.sparkSession)
    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits_col).cast(EDITS).alias("edits"))
    return rows.mapInArrow(change(tokenizer or public_file()), EDITED)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """docs with a column gathered from rows (id_col, seq, start, end, replacement), in the order of seq. The edits of a
    document apply one after another, so they meet in its row. A column of that name is an error; choose another."""
    if edits_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs have a column {edits_col} already")
    entry = F.struct("seq", "start", "end", "replacement")
    gathered = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias(edits_col))
    gathered = gathered.withColumn(edits_col, F.transform(edits_col, lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].alias("replacement"))))
    return docs.join(gathered, id_col, "left")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's tree is written and read back; then three edits for each, made from its own text: eight characters of
    its middle give way to its first twelve, a notice goes in at a place that its id chooses, and its last five go."""
    trees = materialize(token_trees(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-trees")
    n = F.length("text")
    half = F.floor(n / 2)
    edit = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), new.alias("replacement"))
    edits = F.array(
        edit(half, half + 8, F.concat(F.substring("text", 1, 12), F.lit(" "))),
        edit(F.pmod(F.col("doc_id"), n + 1), F.pmod(F.col("doc_id"), n + 1), F.lit(" [edited] ")),
        edit(n - 5, n, F.lit("")),
    )
    found = edited_trees(trees.withColumn("edits", edits))
    return found.select("doc_id", "tokens_before", F.col("tokens").alias("tokens_after"), F.col("chars").alias("chars_after"), "encoded_again", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
