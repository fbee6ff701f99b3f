"""Defaults of the retrieval jobs; pass another Params to change them."""

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    chunk_size: int = 512
    chunk_overlap: int = 64
    table_rows: int = 30
    top_k: int = 20
    over_fetch: int = 3
    fetch_cap: int = 100
    rerank_k: int = 10
    dense_weight: float = 0.6
    bm25_weight: float = 0.4
    rrf_k: int = 60
    dense_threshold: float = 0.6
    rerank_threshold: float = 0.3
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    merge_chars: int = 2000
    context_chars: int = 8000
    hops: int = 2
    paths_per_seed: int = 50
    sql_rows: int = 500
    sql_seconds: float = 5.0
    #: Cuts runs of letters into words, as ``functions.words.segmenter`` makes it.
    segment: Callable | None = None
    #: Common words that carry no topic, in the four languages of the test corpus.
    stop_words: tuple = field(default=tuple("the of and to in is on that it was with as for at by this an be are from und der die das den ist de la le les et en el los las que y un une".split()))


DEFAULT = Params()
