"""Turning texts into vectors, and sizing what does so."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Memory of one instance of the model, of everything around it, and what is left to the rest of the machine.
PER_INSTANCE_RAM = 2560 << 20
EMBEDDING_OVERHEAD = 512 << 20
RESERVE_RAM = 4 << 30
MOST_INSTANCES = 4
_RESULT = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def estimated_ram(instances: Column) -> Column:
    return instances * PER_INSTANCE_RAM + EMBEDDING_OVERHEAD


def auto_sizing(ram: Column, cores: Column) -> Column:
    """``instances``, ``threads`` of each, and the ``estimated`` bytes of memory, for a machine."""
    usable = F.greatest(ram - F.greatest(F.lit(RESERVE_RAM), F.floor(ram / 4)), F.lit(0))
    fit = F.greatest(F.floor(usable / PER_INSTANCE_RAM), F.lit(1))
    instances = F.greatest(F.least(fit, F.least(F.lit(MOST_INSTANCES), cores)), F.lit(1)).cast("long")
    threads = F.greatest(F.floor(cores / instances), F.lit(1)).cast("long")
    return F.struct(instances.alias("instances"), threads.alias("threads"), estimated_ram(instances).cast("long").alias("estimated"))


def hashing_embedder(dim: int = 768):
    """A deterministic stand-in for a model: hashed words with signs. Texts without words fail.

    Its vectors say which words two texts share, no more; they carry an embedder id of their own so as never to mix with
    those of a model.
    """
    import re
    import zlib

    word = re.compile(r"\w+")

    @F.pandas_udf(_RESULT)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = [], []
            for text in batch:
                found = [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in word.findall(text or "")]
                if not found:
                    vectors.append(None)
                    errors.append("no words to embed")
                    continue
                h = np.array(found, np.int64)
                vectors.append(np.bincount(h % dim, np.where(h >> 16 & 1, 1.0, -1.0), dim).astype(np.float32))
                errors.append(None)
            yield pd.DataFrame({"vector": vectors, "error": errors})

    return embed


def onnx_embedder(model_dir: str, *, max_tokens: int = 8192, threads: int = 1):
    """Mean-pooled last states of an ONNX model: ``model_dir`` holds ``model.onnx`` and ``tokenizer.json`` on every executor.

    The session is opened once per Python worker; a text that the model fails on gives an error instead of a vector.
    """

    @F.pandas_udf(_RESULT)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        session = onnxruntime.InferenceSession(os.path.join(model_dir, "model.onnx"), options)
        tokenizer = Tokenizer.from_file(os.path.join(model_dir, "tokenizer.json"))
        tokenizer.enable_truncation(max_tokens)
        inputs = {i.name for i in session.get_inputs()}
        for batch in batches:
            vectors, errors = [], []
            for text in batch:
                try:
                    encoded = tokenizer.encode(text)
                    if not encoded.ids:
                        raise ValueError("no tokens to embed")
                    ids = np.array([encoded.ids], np.int64)
                    given = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
                    states = session.run(None, {k: v for k, v in given.items() if k in inputs})[0]
                    vectors.append(states[0].mean(axis=0).astype(np.float32))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a model raises belongs to its text
                    vectors.append(None)
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"vector": vectors, "error": errors})

    return embed
