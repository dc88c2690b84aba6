"""The words of a batch of texts as codes into its distinct words, so that work per word is done once a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, a code for each word of each text, and the first word of each text (one more than texts).

    Splits at ASCII white space; lower: ASCII letters in lower case. A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    first = split.offsets.to_numpy() - split.offsets[0].as_py()
    if "" in words:  # a text that begins or ends with white space, or is empty
        real = codes != words.index("")
        first = np.r_[0, np.cumsum(real)][first]
        codes = codes[real]
    return words, codes, first
