"""Which tokens of two tokenizers cover the same bytes of a text.

Both sides cut the bytes of a space and the text. A batch's tokens are two tables
keyed by document, ordered by where a token starts. ``merge_asof`` finds for each
token the other side's token that starts last before it or with it, which is the
one that covers its first byte. Two tokens overlap exactly if one of them covers
the first byte of the other, so the union of both directions is all overlaps.
Where tokens of both sides end together a group ends.

How often an id pair is linked is counted over the whole corpus. Documents are
handled in chunks of bounded size: a chunk keeps each of its pairs once, and its
documents refer to them by place. Pairs of chunks, not links of documents, are
counted and asked for, and the answers come back to the chunk.

Defined cases: a NULL or empty text has no tokens, and neither has one whose
tokens do not give back its bytes on either side (a tokenizer that folds
characters); repeated rows and NULL ids are rows of their own; an empty table gives
no rows. A text is tokenized whole however long it is. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulcost.llm.tokens import Coder, encoder
from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage

#: A chunk ends with the document that brings it to either figure.
CHUNK_DOCUMENTS = 512
CHUNK_BYTES = 2 << 20
#: Fixed value: the mark that stands for a space in the pieces' spelling.
SPACE_MARK = "▁"


class Side(NamedTuple):
    """A tokenizer's entries: the bytes of each, and their lengths."""

    spelled: list[bytes]
    lengths: np.ndarray


@cache
def _plain_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@cache
def byte_side(coder: Coder) -> Side:
    spelled = [b""] * coder.ranks.n_vocab
    for token in coder.ranks.token_byte_values():
        spelled[coder.ranks.encode_single_token(token)] = token
    return Side(spelled, np.array([len(x) for x in spelled], np.int64))


@cache
def _pieces(model_file: str | None) -> sentencepiece.SentencePieceProcessor:
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


@cache
def piece_side(model_file: str | None = None) -> Side:
    model = _pieces(model_file)
    spelled = [
        bytes([int(model.id_to_piece(i)[3:-1], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        for i in range(model.get_piece_size())
    ]
    return Side(spelled, np.array([len(x) for x in spelled], np.int64))


def byte_ids(text: str, coder: Coder) -> np.ndarray:
    """Ids under the byte-level vocabulary; strings of special tokens are plain text."""
    try:
        return coder.ranks.encode_to_numpy(text, disallowed_special=())
    except ValueError:  # a run too long for the pattern's stack
        if coder.tokenizer_file is None:
            raise
    ids = _plain_tokenizer(coder.tokenizer_file).encode(text, add_special_tokens=False).ids
    return np.array(ids, np.uint32)


class Aligned(NamedTuple):
    """Tokens of several documents and what connects them.

    ``a`` and ``b`` hold doc, id, start and end (bytes from the start of the first
    document) and group; ``link_a`` and ``link_b`` are places in them.
    """

    a: pd.DataFrame
    b: pd.DataFrame
    link_a: np.ndarray
    link_b: np.ndarray


def _tokens(ids: Sequence[Sequence[int]], side: Side) -> pd.DataFrame:
    counts = [len(x) for x in ids]
    flat = np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in ids]])
    lengths = side.lengths[flat]
    end = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(ids)), counts)
    return pd.DataFrame({"doc": doc, "id": flat, "start": end - lengths, "end": end})


def align(
    a_ids: Sequence[Sequence[int]], b_ids: Sequence[Sequence[int]], a_side: Side, b_side: Side
) -> Aligned:
    """Groups and links of documents whose tokens spell the same bytes on both sides."""
    a, b = _tokens(a_ids, a_side), _tokens(b_ids, b_side)

    def covering(tokens: pd.DataFrame, others: pd.DataFrame) -> np.ndarray:
        starts = others[["doc", "start"]].assign(place=np.arange(len(others)))
        found = pd.merge_asof(tokens[["doc", "start"]], starts, on="start", by="doc")
        return found["place"].to_numpy(np.int64)

    if not len(a):
        none = np.empty(0, np.int64)
        return Aligned(a.assign(group=none), b.assign(group=none), none, none)
    over, under = covering(a, b), covering(b, a)
    # A token that starts with its cover was found from the other side already.
    new = a["start"].to_numpy()[under] != b["start"].to_numpy()
    link_a = np.concatenate([np.arange(len(a)), under[new]])
    link_b = np.concatenate([over, np.flatnonzero(new)])
    a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()
    meets = np.searchsorted(b_end, a_end)  # both sides of a document end together
    shared = b_end[meets] == a_end
    shared_b = np.zeros(len(b), bool)
    shared_b[meets[shared]] = True
    for tokens, last in ((a, shared), (b, shared_b)):
        tokens["group"] = np.cumsum(last) - last
    return Aligned(a, b, link_a, link_b)


@cache
def _marked(entries: int) -> list[bytes]:
    """Every id before a comma, a bar and a semicolon."""
    numbers = [str(i).encode() for i in range(entries)]
    return [x + mark for mark in (b",", b"|", b";") for x in numbers]


def spelled_groups(found: Aligned, a_entries: int, b_entries: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for every document of the alignment, by its number."""
    a, b = found.a, found.b
    entries = max(a_entries, b_entries)
    table = _marked(entries)
    if not len(a):
        return []
    last_a = np.append(np.diff(a["group"].to_numpy()) > 0, True)
    last_b = np.append(np.diff(b["group"].to_numpy()) > 0, True)
    text = np.empty(len(a) + len(b), np.int64)
    # An A token stands behind the B tokens of the groups before, a B token behind the
    # A tokens of its group and those before.
    a_upto, b_upto = np.cumsum(np.bincount(a["group"])), np.cumsum(np.bincount(b["group"]))
    before = np.concatenate([[0], b_upto])[a["group"]]
    text[np.arange(len(a)) + before] = a["id"] + last_a * entries
    text[np.arange(len(b)) + a_upto[b["group"]]] = b["id"] + 2 * last_b * entries
    documents = int(a["doc"].iloc[-1]) + 1
    sizes = np.bincount(a["doc"], minlength=documents) + np.bincount(b["doc"], minlength=documents)
    spelled = list(map(table.__getitem__, text.tolist()))
    ends = np.cumsum(sizes).tolist()
    return [b"".join(spelled[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


class Tokenizers(NamedTuple):
    """Files of both sides; the public 50,000 and 32,000 entries unless named."""

    ranks_file: str | None = None
    pattern: str | None = None
    tokenizer_file: str | None = None
    model_file: str | None = None


def _both(
    texts: list[str | None], files: Tokenizers
) -> tuple[list[Sequence[int]], list[Sequence[int]]]:
    """Ids of both sides, none for texts that have no tokens.

    Byte-level tokens are runs of the text's own bytes in order, so that their
    length says whether they are all of it. Pieces are compared byte by byte.
    """
    coder = encoder(files.ranks_file, files.pattern, files.tokenizer_file)
    a_lengths, b_spelled = byte_side(coder).lengths, piece_side(files.model_file).spelled
    plain = [x or "" for x in texts]
    a_ids = [byte_ids(f" {x}", coder) if x else [] for x in plain]
    b_ids = _pieces(files.model_file).encode(plain, num_threads=1)
    for i, text in enumerate(plain):
        whole = f" {text}".encode()
        if (
            not text
            or b"".join(map(b_spelled.__getitem__, b_ids[i])) != whole
            or a_lengths[a_ids[i]].sum() != len(whole)
        ):
            a_ids[i] = b_ids[i] = []
    return a_ids, b_ids


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of bounded number and bytes; a longer text is a chunk of its own."""
    start = size = 0
    for i, text in enumerate(batch.column("text")):
        length = 0 if not text.is_valid else text.as_buffer().size
        if i > start and (i - start >= CHUNK_DOCUMENTS or size + length > CHUNK_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if batch.num_rows:
        yield batch.slice(start)


def links(documents: DataFrame, files: Tokenizers = Tokenizers()) -> DataFrame:
    """Every overlap as a row: doc_id, both tokens' number and id, their group, and the shared bytes.

    ``start`` and ``end`` are byte offsets in a space and the text.
    """

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side = byte_side(encoder(files.ranks_file, files.pattern, files.tokenizer_file))
        b_side = piece_side(files.model_file)
        for chunk in chain.from_iterable(map(_chunks, batches)):
            a_ids, b_ids = _both(chunk.column("text").to_pylist(), files)
            found = align(a_ids, b_ids, a_side, b_side)
            order = np.lexsort((found.link_b, found.link_a))
            found = found._replace(link_a=found.link_a[order], link_b=found.link_b[order])
            a = found.a.iloc[found.link_a].reset_index(drop=True)
            b = found.b.iloc[found.link_b].reset_index(drop=True)
            first = found.a.groupby("doc")["start"].min()
            base = a["doc"].map(first).to_numpy(np.int64)
            first_a = np.searchsorted(found.a["doc"], a["doc"])
            first_b = np.searchsorted(found.b["doc"], b["doc"])
            group = a["group"].to_numpy() - found.a["group"].to_numpy()[first_a]
            numbers = [
                found.link_a - first_a,
                found.link_b - first_b,
                a["id"],
                b["id"],
                group,
                np.maximum(a["start"], b["start"]) - base,
                np.minimum(a["end"], b["end"]) - base,
            ]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").take(pa.array(a["doc"], pa.int64()))]
                + [pa.array(np.asarray(x, np.int64)) for x in numbers],
                names=["doc_id", "a", "b", "a_id", "b_id", "token_group", "start", "end"],
            )

    docs = take(documents, doc_id="doc_id", text="text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("a", "b", "a_id", "b_id", "token_group", "start", "end")
    return docs.mapInArrow(connect, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _digested(chunk: pa.RecordBatch, files: Tokenizers) -> pa.RecordBatch:
    """One row for a chunk: its id pairs with their links, and its documents, which refer to them."""
    a_side = byte_side(encoder(files.ranks_file, files.pattern, files.tokenizer_file))
    b_side = piece_side(files.model_file)
    found = align(*_both(chunk.column("text").to_pylist(), files), a_side, b_side)
    rows = chunk.num_rows
    a_docs, b_docs = found.a["doc"].to_numpy(), found.b["doc"].to_numpy()
    link_docs = a_docs[found.link_a]
    ids = found.a["id"].to_numpy()[found.link_a] << 32 | found.b["id"].to_numpy()[found.link_b]
    pairs, place, totals = np.unique(ids, return_inverse=True, return_counts=True)
    own, times = np.unique(link_docs * max(1, len(pairs)) + place, return_counts=True)
    offsets = np.searchsorted(own, np.arange(rows + 1) * max(1, len(pairs)))
    group_ends = np.append(np.diff(found.a["group"].to_numpy()) > 0, True)[: len(a_docs)]
    spelled = spelled_groups(found, len(a_side.spelled), len(b_side.spelled))
    spelled += [b""] * (rows - len(spelled))
    counts = [
        np.bincount(a_docs, minlength=rows),
        np.bincount(b_docs, minlength=rows),
        np.bincount(a_docs, group_ends, minlength=rows).astype(np.int64),
        np.bincount(link_docs, minlength=rows),
    ]
    lists = [
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()))
        for x in (own % max(1, len(pairs)), times)
    ]
    documents = pa.StructArray.from_arrays(
        [
            chunk.column("doc_id"),
            *[pa.array(x, pa.int64()) for x in counts],
            pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in spelled]),
            *lists,
        ],
        names=["doc_id", *_COUNTS, "groups_sha256", "places", "times"],
    )
    whole = pa.array([0, rows], pa.int32())
    ends = pa.array([0, len(pairs)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())),
            pa.ListArray.from_arrays(ends, pa.array(totals, pa.int64())),
            pa.ListArray.from_arrays(whole, documents),
        ],
        names=["pairs", "totals", "documents"],
    )


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every document of the chunks, from the corpus-wide counts of their pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            documents = batch.column("documents")[i].values
            answers = batch.column("answers")[i].values
            sums = {}
            places = documents.field("places").flatten().to_numpy()
            times = documents.field("times").flatten().to_numpy().astype(np.int64)
            lengths = documents.field("times").value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(lengths)
            best = answers.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
            values = {"n_best": best, "count_sum": answers.field("links").to_numpy()}
            for name, value in values.items():
                upto = np.concatenate([[0], np.cumsum(value[places] * times)])
                sums[name] = upto[ends] - upto[ends - lengths]
            yield pa.RecordBatch.from_arrays(
                [documents.field("doc_id")]
                + [documents.field(x) for x in _COUNTS]
                + [pa.array(x, pa.int64()) for x in sums.values()]
                + [documents.field("groups_sha256")],
                names=["doc_id", *_COUNTS, *sums, "groups_sha256"],
            )


def digests(documents: DataFrame, files: Tokenizers = Tokenizers()) -> DataFrame:
    """Per document the numbers of tokens, groups and links, and how common its links are.

    ``n_best`` counts links whose id pair is the most linked of its B id in the corpus,
    ``count_sum`` adds the corpus-wide counts of the id pairs over the links.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chain.from_iterable(map(_chunks, batches)):
            yield _digested(chunk, files)

    docs = take(documents, doc_id="doc_id", text="text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    document = f"struct<doc_id: {kind}, " + ", ".join(f"{x}: long" for x in _COUNTS)
    document += ", groups_sha256: string, places: array<int>, times: array<int>>"
    chunks = docs.mapInArrow(
        digest, f"pairs array<long>, totals array<long>, documents array<{document}>"
    )
    # The number of a chunk is stored with it, so that it stays when a task runs again.
    chunks = cut_lineage(chunks.select(F.monotonically_increasing_id().alias("chunk"), "*"))
    counts = (
        chunks.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.totals").alias("links"))
    )
    # No B id has more pairs than the other side has entries.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1))
    counts = cut_lineage(
        counts.withColumn("best", F.col("links") == F.max("links").over(of_b))
    )
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    answers = (
        asked.join(counts, "pair")
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list(F.struct("place", "links", "best"))).alias("answers"))
    )
    asking = chunks.select("chunk", "documents").join(answers, "chunk", "left")
    none = F.array().cast("array<struct<place: int, links: bigint, best: boolean>>")
    asking = asking.select("documents", F.coalesce("answers", none).alias("answers"))
    names = ", ".join(f"{x} long" for x in (*_COUNTS, "n_best", "count_sum"))
    return asking.mapInArrow(_scored, f"doc_id {kind}, {names}, groups_sha256 string")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the piece vocabulary."""
    found = digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
