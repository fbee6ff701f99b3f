"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts with one state and one arc per byte, so that it accepts every byte string. Each merge rule (u, v) is then
applied as a gadget, in the order of the rules: behind u the arc v is taken away (the state that u leads to is split for that),
and wherever an arc u is, an arc uv is added that leads where v led. In the end it accepts exactly the token sequences that
the rules produce, so every byte string has one path, and every prefix of it too.

All arcs of one token lead to one state, so a state is the set of arcs that it lacks. The tokens that begin with v and are made
after a rule are a range of places, if tokens stand in preorder of their left parts, latest first. So one gadget takes one range
from one state, and the tables are: place and target state of every token, and for every state its sorted ranges. A word is
encoded by following arcs that spell it, and decoded by emitting their labels.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from millrace.llm.hashing import slices
from millrace.llm.scratch import plain, restored, small_batches, tidied
from millrace.llm.tokens import PATTERN, byte_of, public_file

ENCODED = "doc_id bigint, ids binary"
DECODED = "doc_id bigint, ids binary, text string"
#: A worker keeps up to twice so many words with their ids, the latest ones, none of more characters; others are encoded again.
KEPT_WORDS, KEPT_LENGTH = 1 << 19, 64


def unlike(tokenizer) -> str:
    """Code points that the pattern's engine takes for letters or digits and the tokenizer's own engine does not. Both follow the
    same standard in editions of their own, so they can differ only where Python's older edition has nothing assigned."""
    word = regex.compile(r"[\p{L}\p{N}]")
    asked = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and word.match(chr(c))]
    out = []
    for prefix, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
        own = [c for c in asked if regex.match(kind, chr(c))]
        ends = {b for _, (_, b) in tokenizer.pre_tokenizer.pre_tokenize_str("\n".join(prefix + chr(c) for c in own))}
        out += [chr(c) for i, c in enumerate(own) if 3 * i + 1 in ends]
    return "".join(out)


class Automaton:
    """Plain tables, fit for a broadcast by ``plain`` and ``restored``. State 0 is the start."""

    labels: list[bytes]
    place: np.ndarray
    target: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    added: dict[str, int]
    odd: str

    def __init__(self, ids: dict[bytes, int], rules: list[tuple[bytes, bytes]], added: dict[str, int] | None = None, odd: str = "") -> None:
        """ids: of all tokens by their bytes; rules: pairs of tokens, each made by a rule before or a single byte. A token of two
        rules, or a rule before those of its parts, is an error: sequential and ranked merging would then differ."""
        self.added, self.odd = added or {}, odd
        size = 1 + max([*ids.values(), *self.added.values()])
        self.labels = [b""] * size
        for token, i in [*ids.items(), *((x.encode(), i) for x, i in self.added.items())]:
            self.labels[i] = token
        made = {ids[bytes([b])]: -1 for b in range(256)}
        heads: dict[int, list[tuple[int, int]]] = {}
        pairs = []
        for rank, (left, right) in enumerate(rules):
            u, v, w = ids[left], ids[right], ids[left + right]
            if w in made or u not in made or v not in made:
                raise ValueError(f"rule {rank} makes a token anew or from tokens that are not there yet")
            made[w] = rank
            heads.setdefault(u, []).append((rank, w))
            pairs.append((u, v, w))
        self.place, span = np.full(size, -1, np.int32), [0] * size
        at = 0
        stack = [t for t, rank in made.items() if rank < 0]
        while stack:  # preorder, the latest rule of a head first
            t = stack.pop()
            if t < 0:
                span[~t] = at
                continue
            self.place[t] = at
            at += 1
            stack += [~t, *(w for _, w in heads.get(t, []))]
        place, seen = self.place.tolist(), {}
        lacks: dict[int, list[tuple[int, int]]] = {t: [] for t, rank in made.items() if rank < 0}
        gone = set()
        for rank, (u, v, w) in enumerate(pairs):
            if u in gone or v in gone or any(a <= place[v] < b for a, b in lacks[u]):
                gone.add(w)  # no path has u before v, so nothing changes and nothing makes w
                continue
            later = [x for x in heads.get(v, []) if x[0] >= rank]
            lacks[w] = lacks[v].copy()
            lacks[u].append((place[v], span[later[0][1]] if later else place[v] + 1))
        self.target, begin, end, first = np.full(size, -1, np.int32), [], [], [0, 0]
        seen[()] = 0
        for t, ranges in lacks.items():
            joined: list[list[int]] = []
            for a, b in sorted(ranges):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            key = tuple(x for r in joined for x in r)
            if key not in seen:
                seen[key] = len(seen)
                begin += key[0::2]
                end += key[1::2]
                first.append(len(begin))
            self.target[t] = seen[key]
        self.begin, self.end, self.first = (np.asarray(x, np.int32) for x in (begin, end, first))

    @classmethod
    def of_file(cls, path: str) -> Automaton:
        """From a tokenizers file of a byte-level BPE that uses the pattern, without normaliser, prefix space and dropout."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain_model = model["type"] == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        plain_words = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain_model or not plain_words or file["normalizer"] or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE")
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        spelt = lambda token: bytes(map(byte_of().__getitem__, token))
        rules = [tuple(map(spelt, x.split(" ") if isinstance(x, str) else x)) for x in model["merges"]]
        return cls({spelt(x): i for x, i in model["vocab"].items() if x not in added}, rules, added, unlike(Tokenizer.from_file(path)))


class Coder:
    """Encodes and decodes by the tables of an automaton."""

    def __init__(self, automaton: Automaton) -> None:
        a = automaton
        self.labels, self.place, self.target = a.labels, a.place.tolist(), a.target.tolist()
        self.begin, self.end, self.first = a.begin.tolist(), a.end.tolist(), a.first.tolist()
        self.words = regex.compile(PATTERN).findall
        strict = PATTERN.replace(r"\p{L}", r"[\p{L}--[%s]]" % a.odd, 1).replace(r"\p{N}", r"[\p{N}--[%s]]" % a.odd, 1).replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[%s])" % a.odd)
        self.strict = regex.compile("(?V1)" + strict).findall if a.odd else self.words
        self.is_odd = np.zeros(0x110000, bool)
        self.is_odd[[ord(c) for c in a.odd]] = True
        self.added = a.added
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(a.added, key=len, reverse=True)) + ")").split if a.added else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.longest = max(map(len, self.labels))
        # a trie of the tokens: by node and byte the next node, and by node the token that ends there
        self.next: dict[int, int] = {}
        self.token = [-1]
        for t, state in enumerate(self.target):
            if state >= 0:
                node = 0
                for b in self.labels[t]:
                    to = self.next.setdefault(node << 8 | b, len(self.token))
                    if to == len(self.token):
                        self.token.append(-1)
                    node = to
                self.token[node] = t

    def path(self, word: bytes) -> list[int]:
        """The tokens on the one path that spells the word. Longer arcs are tried first; as a prefix has one path, a place from
        which the end wasn't reached is never tried again, so steps are in proportion to the length."""
        goto, token, labels, place, target, begin, end, first = self.next.get, self.token, self.labels, self.place, self.target, self.begin, self.end, self.first
        out: list[int] = []
        untried: list[list[int]] = []
        dead: set[int] = set()
        at, state, size = 0, 0, len(word)
        while at < size:
            found, node = [], 0
            for b in word[at : at + self.longest]:
                node = goto(node << 8 | b)
                if node is None:
                    break
                if token[node] >= 0:
                    found.append(token[node])
            while True:
                if not found:
                    dead.add(at)
                    found = untried.pop()
                    at -= len(labels[out.pop()])
                    state = target[out[-1]] if out else 0
                    continue
                t = found.pop()
                if dead and at + len(labels[t]) in dead:
                    continue
                low = first[state]
                i = bisect_right(begin, place[t], low, first[state + 1]) - 1
                if i < low or end[i] <= place[t]:
                    break
            out.append(t)
            untried.append(found)
            at += len(labels[t])
            state = target[t]
        return out

    def ids_of(self, word: str) -> bytes:
        found = self.kept.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                path = self.path(word.encode())
                found = struct.pack(f"<{len(path)}I", *path)
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept, self.older = {}, self.kept
                self.kept[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        words = self.words if text.isascii() or not self.is_odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any() else self.strict
        return b"".join(map(self.ids_of, words(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(x in text for x in self.added):
            return self._plain(text)
        return b"".join(self._plain(x) if k % 2 == 0 else self.added[x].to_bytes(4, "little") for k, x in enumerate(self.cut(text)))

    def decode(self, ids: bytes) -> str:
        return spelt(self.labels, ids)


def spelt(labels: list[bytes], ids: bytes) -> str:
    """The labels of the arcs, as UTF-8 with replacement characters for what is none. Unknown ids have no label."""
    codes = np.frombuffer(ids, "<u4")
    known = codes if not len(codes) or codes.max() < len(labels) else codes[codes < len(labels)]
    return b"".join(map(labels.__getitem__, known.tolist())).decode("utf-8", "replace")


def _coder(shared) -> Coder:
    """One coder per worker and broadcast."""
    kept = regex.__dict__.setdefault("_millrace_coders", {})
    if shared.value["number"] not in kept:
        kept.clear()
        kept[shared.value["number"]] = Coder(restored(Automaton, shared.value["tables"]))
    return kept[shared.value["number"]]


def share(spark, automaton: Automaton):
    """The automaton as a broadcast; its size depends on the vocabulary alone."""
    return spark.sparkContext.broadcast({"number": uuid.uuid4().hex, "tables": plain(automaton)})


def encoded(df: DataFrame, automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row; ``automaton`` is what ``share`` gave. ids is binary: little-endian unsigned 32-bit integers.

    Null and empty texts have no ids, an added token's string is that token. Repeated rows come out repeated, null ids as null;
    an empty table gives no rows; other columns are not read. Words of any length take memory and time in proportion."""
    small_batches(df.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(automaton)
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = [coder.encode(x or "") for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decoded(df: DataFrame, automaton, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the decoded text of every row of ``encoded``. Null ids are empty; ids without a token are left out."""
    small_batches(df.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = automaton.value["tables"]["labels"]
        for batch in batches:
            for piece in slices(batch, "ids"):
                texts = [spelt(labels, x or b"") for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, DECODED)


def query(spark, sf_dir: str) -> DataFrame:
    automaton = share(spark, Automaton.of_file(public_file()))
    out = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), automaton), automaton)
    text = F.sha2(F.encode("text", "UTF-8"), 256)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), text.alias("decoded_sha256"))
