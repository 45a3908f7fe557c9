"""Cross-tokenizer alignment: which tokens of one tokenizer stand for the same bytes as which of another.

Both tokenizers' tokens are laid over the bytes of the text. A packed bitset has a bit for each byte where a token
ends. AND of the two gives the cuts that both share, and these cut the tokens into groups; counts of set bits (rank)
turn a byte into the number of a token, and so groups into ranges of tokens; OR gives the places where a link ends,
as between two neighbouring ends of any kind just one token of either side overlaps with one of the other.

Texts are encoded once, by a map over rows. Of each text go on: its groups, and its different linked id pairs with
their numbers. Pairs are summed in tasks before Spark sums them. The table of pairs is bounded by the vocabularies,
not by the corpus; up to MAX_TABLE pairs it is broadcast, beyond that texts' pairs are joined with it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import free_name, idle_memory, written
from vellum.llm.fmindex import Bits

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokenizer files larger than this are refused rather than broadcast.
MAX_FILE_BYTES = 64 << 20
#: Id pairs (of 17 bytes) that are broadcast at most.
MAX_TABLE = 4_000_000
#: Texts are encoded in pieces of at least so many characters, and so many characters are laid out at once.
PIECE_CHARS, BATCH_CHARS = 1 << 16, 1 << 20
#: Neither tokenizer joins a letter or digit with a single space behind it and what follows: a text may be cut there.
SAFE_CUT = re.compile(r"(?<=\w)(?= \w)")

_loaded: dict = {}


def byte_level() -> dict[str, int]:
    """The byte behind each character of byte-level entries: printable ones stand for themselves, the others for
    characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A long text cut where both tokenizers begin anew; the space at a cut is left out."""
    start = 0
    while len(text) - start > size:
        found = SAFE_CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start() + 1
    yield text[start:]


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(file_a.decode())
        self.a.encode_special_tokens = True
        back = byte_level()
        self.bytes_a: list[bytes] = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Decimal ids with what follows them: a comma, or the end of the group's side.
        self.shown = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for each text; None where the text is empty or either's bytes are not space+text."""
        cut = [list(pieces(t)) for t in texts]
        flat = [p for c in cut for p in c]
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in flat], add_special_tokens=False)]
        ids_b = self.b.encode(flat, num_threads=1)
        out, at = [], 0
        for text, c in zip(texts, cut):
            a, b = ([i for x in ids[at : at + len(c)] for i in x] if len(c) > 1 else ids[at] for ids in (ids_a, ids_b))
            at += len(c)
            whole = f" {text}".encode()
            same = text and b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


class Alignment:
    """Tokens of several texts laid over their bytes, one text behind the other."""

    def __init__(self, ids: list[tuple[np.ndarray, np.ndarray]], lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.a, self.b = (np.concatenate([x[k] for x in ids] + [np.zeros(0, np.int64)]) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        # the last byte of each token
        self.end_a, self.end_b = np.cumsum(lengths_a[self.a]) - 1, np.cumsum(lengths_b[self.b]) - 1
        size = int(self.end_a[-1]) + 1 if len(self.end_a) else 0
        self.marks_a, self.marks_b = self._marks(self.end_a, size), self._marks(self.end_b, size)
        self.shared = self.marks_a & self.marks_b
        # the byte behind each text
        self.until = self.end_a[np.cumsum(self.n_a) - 1] + 1 if len(ids) else np.zeros(0, np.int64)
        either = self.marks_a | self.marks_b
        link_ends = either.places()
        #: Token numbers of each link.
        self.link_a, self.link_b = self.marks_a.rank(link_ends), self.marks_b.rank(link_ends)
        self.links_until, self.groups_until = either.rank(self.until), self.shared.rank(self.until)

    @staticmethod
    def _marks(ends: np.ndarray, size: int) -> Bits:
        bits = np.zeros(size, bool)
        bits[ends] = True
        return Bits(bits)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """For each group the number of the first token behind it, on both sides."""
        cuts = self.shared.places()
        return self.marks_a.rank(cuts + 1), self.marks_b.rank(cuts + 1)

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its different linked id pairs (a * 2**32 + b), ascending, and how many links hold each."""
        packed = (self.a[self.link_a] << 32) | self.b[self.link_b]
        return [np.unique(p, return_counts=True) for p in np.split(packed, self.links_until[:-1])] if len(self.until) else []

    def shown(self, table: list[str], first_b: int) -> list[str]:
        """For each text its groups: ids of both sides as a1,a2|b1;a3|b2,b3."""
        group_a, group_b = self.shared.rank(self.end_a), self.shared.rank(self.end_b)
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        codes = np.concatenate([self.a * 2 + last_a, first_b + self.b * 2 + last_b])[order]
        return ["".join([table[c] for c in part.tolist()])[:-1] for part in np.split(codes, np.cumsum(self.n_a + self.n_b)[:-1])] if len(self.until) else []


def _tokenizers(files) -> Tokenizers:
    """One for each Python worker and pair of files."""
    digest, shared = files
    if digest not in _loaded:
        _loaded[digest] = Tokenizers(*shared.value)
    return _loaded[digest]


def _broadcast(df: DataFrame, path_a: str | None, path_b: str | None):
    paths = [Path(path_a or public_tokenizers.path(TOKENIZER_A)), Path(path_b or public_tokenizers.path(TOKENIZER_B))]
    for path in paths:
        if (size := path.stat().st_size) > MAX_FILE_BYTES:
            raise ValueError(f"{path} has {size} bytes; at most {MAX_FILE_BYTES} are broadcast")
    data = tuple(p.read_bytes() for p in paths)
    return hashlib.sha256(b"".join(data)).hexdigest(), df.sparkSession.sparkContext.broadcast(data)


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where texts begin that are laid out together, and these."""
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        held.append(texts[i].as_py() or "")
        size += len(held[-1])
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


_ALIGNED = [
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
]


def align(df: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False, out: str = "aligned") -> DataFrame:
    """Adds a struct of n_a, n_b (tokens), n_groups, n_links, groups, pairs (a * 2**32 + b of each different linked
    pair of ids, ascending) and times (links of the text that hold it).

    A text's bytes are space+text. groups: ids of each group as a1,a2|b1;a3|b2,b3, or with digest its SHA-256 in hex.
    A text that is null or empty, or that either tokenizer changes, has no tokens: zeros, '' and empty arrays.
    Special tokens' strings in a text are ordinary text. A column of the name out is replaced.
    """
    files = _broadcast(df, path_a, path_b)

    def run(texts: pa.Array) -> pa.Array:
        both = _tokenizers(files)
        rows: list[tuple] = []
        for _, some in _batches(texts):
            ids = both.encode(some)
            laid = Alignment([x for x in ids if x is not None], both.lengths_a, both.lengths_b)
            shown = laid.shown(both.shown, 2 * len(both.bytes_a))
            n_links, n_groups = (np.diff(x, prepend=0).tolist() for x in (laid.links_until, laid.groups_until))
            there = zip(laid.n_a.tolist(), laid.n_b.tolist(), n_groups, n_links, shown, laid.pairs())
            for x in ids:
                if x is None:
                    rows.append((0, 0, 0, 0, "", [], []))
                else:
                    *n, groups, (pairs, times) = next(there)
                    rows.append((*n, hashlib.sha256(groups.encode()).hexdigest() if digest else groups, pairs, times.astype(np.int32)))
        columns = list(zip(*rows)) or [()] * len(_ALIGNED)
        done = pa.StructArray.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _ALIGNED)], names=[n for n, _ in _ALIGNED])
        del rows, columns
        idle_memory()
        return done

    kind = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,pairs:array<bigint>,times:array<int>>"
    return df.withColumn(out, F.arrow_udf(run, kind)(F.col(text)))


def link_counts(rows: DataFrame, pairs: str = "pairs", times: str = "times") -> DataFrame:
    """pair, count (links that hold it, over all rows), best (no pair of its b id has more)."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            ids, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, where, np.concatenate([h[1] for h in held]))
            return ids, n

        for batch in batches:
            held.append(tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1)))
            size += len(held[-1][0])
            if size > 1 << 22:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 21:  # few pairs meet: sums so far go on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "count"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["pair", "count"])
        idle_memory()

    counts = rows.select(pairs, times).mapInArrow(summed, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    # an id has no more pairs than the other vocabulary has entries
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.withColumn("best", F.col("count") == most)


def score_links(df: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, max_table: int = MAX_TABLE) -> DataFrame:
    """The rows with n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens), n_best (links whose pair no
    other pair of its b id exceeds) and count_sum (of the links' pair counts), which count links of all rows.

    Columns of these names are replaced; cases are those of align. Repeated rows count each. An empty table stays so.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    inner = free_name(df, "aligned")
    laid = align(df, text, path_a, path_b, digest=True, out=inner)
    rest = [c for c in df.columns if c.lower() not in new]
    renamed = [F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]
    rows = written(laid.select(*renamed, f"{inner}.*"), release=True)
    counts = written(link_counts(rows), release=True)
    found = counts.count()
    if found <= max_table:
        table = counts.toArrow()
        order = np.argsort(table["pair"].to_numpy())
        packed = tuple(np.ascontiguousarray(table[c].to_numpy()[order]) for c in ("pair", "count", "best"))
        shared = df.sparkSession.sparkContext.broadcast(packed)

        def look_up(pairs: pa.Array, times: pa.Array) -> pa.Array:
            known, count, best = shared.value
            n = pairs.value_lengths().to_numpy(zero_copy_only=False)
            links = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(known, pairs.flatten().to_numpy(zero_copy_only=False))
            cuts = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[0], np.cumsum(links * x[at])]) for x in (best.astype(np.int64), count)]
            return pa.StructArray.from_arrays([pa.array(np.diff(s[cuts])) for s in sums], names=["n_best", "count_sum"])

        scored = rows.withColumn("links", F.arrow_udf(look_up, "struct<n_best:bigint,count_sum:bigint>")("pairs", "times")).select("*", "links.*")
    else:
        # texts of equal groups have equal pairs
        each = rows.where("n_links > 0").groupBy("groups").agg(F.first("pairs").alias("pairs"), F.first("times").alias("times"))
        links = each.select("groups", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("groups", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
        joined = links.join(counts, "pair").groupBy("groups")
        sums = joined.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        scored = rows.join(sums, "groups", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return scored.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rest)], "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256"), "n_best", "count_sum")
