"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

``remove_repeats(docs)`` removes each word that lies in a window of ``width`` words whose word sequence starts
anywhere else too, in the same or another text; repeated windows merge into maximal intervals. Windows are judged on
the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Texts whose words are all kept are rejoined by one blank too.

Texts of any length are read whole, each in one task, with some fifty bytes of work memory a byte of text. Null and
empty texts have no words and come out as ``""``. Repeated rows count as repeats of each other, whatever
their ids. Every other column passes unchanged; ``n_words`` and ``n_removed`` replace columns of those names. An
empty table gives an empty table. Hashes have 64 bits: two different windows collide with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgergrain.llm import repeats, textops

WIDTH = 35


def _windows(column, width: int):
    """Per slice of texts: bytes, offsets, words and the starts and hashes of the windows."""
    data, offsets = textops.flat(column)
    for low, high in textops.slices(offsets):
        cut = offsets[low : high + 1]
        part, cut = data[cut[0] : cut[-1]], cut - cut[0]
        starts, ends, owner = textops.spans(part, cut)
        at, hashes = textops.window_hashes(textops.run_hashes(part, starts, ends), owner, width)
        yield part, cut, starts, ends, owner, at, hashes


def _keys(text: str, width: int):
    def keys(table: pa.Table, _: pa.Table) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(s[-1] for s in _windows(table.column(text), width))])

    return keys


def _removed(text: str, width: int, bits: int, block: str, names: list[str]):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        parts = list(_windows(table.column(text), width))
        hashes = np.concatenate([np.empty(0, np.uint64), *(p[-1] for p in parts)])
        twice = repeats.repeated(hashes, answers, bits)
        done, words, gone, kept = 0, [], [], []
        for data, offsets, starts, ends, owner, at, own in parts:
            hit = at[twice[done : done + len(own)]]
            done += len(own)
            drop = textops.covered(hit, width, len(starts))
            kept.append(textops.texts(*textops.joined(data, offsets, starts, ends, owner, ~drop)))
            words.append(np.bincount(owner, minlength=len(offsets) - 1))
            gone.append(np.bincount(owner[drop], minlength=len(offsets) - 1))
        none = np.empty(0, np.int64)
        columns = {n: table.column(n) for n in names}
        columns[text] = pa.chunked_array([k.cast(pa.string()) for k in kept], pa.string())
        columns["n_words"] = pa.array(np.concatenate([none, *words]), pa.int64())
        columns["n_removed"] = pa.array(np.concatenate([none, *gone]), pa.int64())
        return pa.table(columns)

    return remove


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, **sizes: int) -> DataFrame:
    """The rows with repeated windows cut out of ``text``, and their word counts; ``sizes`` as ``repeats.blocked``."""
    docs = docs.drop("n_words", "n_removed")
    blocks = repeats.blocked(docs, text, keys_per_byte=0.2, **sizes)
    names = blocks.names
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in docs.schema]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")]
    )
    answers = repeats.shared(blocks, _keys(text, width))
    return repeats.applied(blocks, answers, _removed(text, width, blocks.bits, blocks.column, names), schema)
