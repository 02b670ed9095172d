"""Extra columns whose names the operators use inside, empty tables, and the digest columns of op4 by plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import lm, media, mixing, packing, pii, quality, queries, shards, simhash, similar, tokens
from tests.llm.test_first_operators import odd

NAMES = "id row n p m h t fp key size crc part word known node first bits least piece start length media payload back feature failed __m source2 content at rate order digest e base rare train task free"
PATH = queries.tokenizer_path()
WAYS = {
    "op2": lambda df: shards.shard_by_bytes(df, 3),
    "op3": simhash.near_duplicates,
    "op4": media.media_columns,
    "op5": lambda df: quality.ledger(df, keep=True).drop("failed"),
    "op6": lambda df: pii.pseudonymise(df, "k"),
    "op7": lambda df: tokens.prefix_tables(df, PATH),
    "op8": lambda df: packing.best_fit(df, PATH, parts=2).drop("sequence_id", "offset"),
    "op9": lambda df: lm.score_documents(df, table_bits=10, spell_bits=10),
    "op10": lambda df: mixing.mix(df).drop("copy"),
    "near_copies": lambda df: similar.near_copies(df.where("doc_id is not null").dropDuplicates(["doc_id"])),
}


@pytest.mark.parametrize("name", WAYS)
def test_clashing_columns_and_empty_tables(spark, name):
    plain = odd(spark)
    more = plain.select("*", *(F.lit(7).alias(c) for c in NAMES.split()))
    way = WAYS[name]
    got, want = way(more), way(plain)
    kept = [c for c in NAMES.split() if c in got.columns and c not in want.columns]
    shared = [c for c in want.columns if c != "failed"]
    key = lambda rows: sorted(map(str, rows))
    assert key(got.select(*(f"`{c}`" for c in shared)).collect()) == key(want.select(*(f"`{c}`" for c in shared)).collect())
    assert all(r[c] == 7 for r in got.select(*(f"`{c}`" for c in kept)).collect() for c in kept)
    assert way(more.limit(0)).count() == 0


def test_stored_pictures_by_plain_python(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_media(spark, sf).collect():
        data = texts[r["doc_id"]]
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        png = media.encode_png(np.frombuffer(payload, np.uint8).tobytes(), 192)
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest())
        assert media.decode_png(png).tobytes() == payload and len(r["feature"]) >= 16
