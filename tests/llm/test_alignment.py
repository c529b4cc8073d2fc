"""Alignment between tokenizers, against both libraries and a walk over the bytes."""

from __future__ import annotations

import collections
import hashlib
from bisect import bisect_left

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulcost.llm import alignment

SCHEMA = "doc_id long, text string"
TEXTS = [
    "The quick brown fox, quickly.",
    "The quick brown fox, quickly.",
    "naïve café — 中文 and 😀 emoji, tabs\tand\n\nlines   with   spaces  ",
    " a leading space, <|endoftext|> and <s> as plain text </s> <unk> ▁ mark",
    "",
    None,
    "é combining, ﬁ ligature,   and ​ and ﻿",
    "x" * 5000 + " " * 5000 + "word " * 4000,
    "\x00 zero \x7f",
]


def letters():
    """The byte of every character that byte-level entries are written with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def expected(texts):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = letters()
    found, counts = [], collections.Counter()
    for text in texts:
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        pieces = map(b_model.id_to_piece, b)
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            found.append(None)
            continue
        owners = [[i for i, x in enumerate(parts) for _ in x] for parts in (a_bytes, b_bytes)]
        links = sorted(set(zip(*owners, strict=True)))
        ends = [[sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 300 else None for parts in (a_bytes, b_bytes)]
        if None in ends:
            ends = [[j + 1 for j in range(len(o)) if j + 1 == len(o) or o[j + 1] != o[j]] for o in owners]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[bisect_left(cuts, e)][side].append(str(i))
        counts.update((a[i], b[j]) for i, j in links)
        spelled = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        found.append((a, b, links, groups, hashlib.sha256(spelled.encode()).hexdigest()))
    highest = collections.Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups, digest = x
        pairs = [(a[i], b[j]) for i, j in links]
        best = sum(counts[p] == highest[p[1]] for p in pairs)
        rows.append((len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in pairs), digest))
    return rows, found


def digests(frame):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[x] for x in names) for r in alignment.digests(frame).collect()}


def test_digests_against_a_walk_over_the_bytes(spark):
    rows, found = expected(TEXTS)
    assert sum(x is None for x in found) >= 2, "some texts do not come back whole"
    frame = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    for parts in (1, 4):  # chunks of one corpus count together
        assert digests(frame.repartition(parts)) == dict(enumerate(rows))


def test_links_carry_places_and_bytes(spark):
    texts = [t for t in TEXTS if t and len(t) < 200]
    _, found = expected(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    made = collections.defaultdict(list)
    for r in alignment.links(frame).collect():
        made[r.doc_id].append(r)
    for doc, x in enumerate(found):
        if x is None:
            assert doc not in made
            continue
        a, b, links, groups, _ = x
        own = sorted(made[doc], key=lambda r: (r.a, r.b))
        assert [(r.a, r.b) for r in own] == links
        assert all(r.a_id == a[r.a] and r.b_id == b[r.b] for r in own)
        assert sum(r.end - r.start for r in own) == len(f" {texts[doc]}".encode())
        assert {r.token_group for r in own} == set(range(len(groups)))
        assert all(str(r.a_id) in groups[r.token_group][0] for r in own)


@pytest.mark.parametrize("documents, size", [(1, 1 << 20), (3, 40), (512, 2 << 20)])
def test_chunks_do_not_change_results(spark, monkeypatch, documents, size):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CHUNK_DOCUMENTS", documents)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": TEXTS})
    chunks = list(alignment._chunks(batch))
    assert [x for c in chunks for x in c.column("doc_id").to_pylist()] == list(range(len(TEXTS)))
    assert all(c.num_rows <= documents for c in chunks)
    rows = [
        alignment._digested(c, alignment.Tokenizers()).column("documents")[0].values.to_pylist() for c in chunks
    ]
    want, _ = expected(TEXTS)
    assert [(d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["groups_sha256"]) for r in rows for d in r] == [
        (*w[:4], w[6]) for w in want
    ]


def test_odd_rows(spark):
    rows = [(None, "one two"), (None, "one two"), (1, None), (1, ""), (2, "one two")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {x: F.lit("other") for x in ("pairs", "chunk", "documents", "place", "links", "a", "start")}
    )
    made = collections.Counter((r.doc_id, r.n_a, r.n_best) for r in alignment.digests(frame).collect())
    assert made[(None, 2, 2)] == 2 and made[(1, 0, 0)] == 2 and made[(2, 2, 2)] == 1
    empty = frame.limit(0)
    assert alignment.digests(empty).count() == 0 and alignment.links(empty).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], SCHEMA)
    assert {r.count_sum for r in alignment.digests(none).collect()} == {0}
    strings = frame.withColumn("doc_id", F.lit("x"))
    assert {r.doc_id for r in alignment.digests(strings).collect()} == {"x"}
