"""Texts packed into containers of fixed capacity.

Sizes are tokens of a public tokenizer. Every task packs the texts it read with
bounded-space online best-fit: at most ``open_bins`` containers are open, held in a
bitset keyed by free space, so the tightest fit is one bit search; when a new one
is needed and all are open, the fullest closes. A text is split only if it exceeds
the capacity. No row is shuffled: the open containers are all the state there is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OPEN_BINS = 64
#: The pre-token pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PACKED = "doc_id bigint, pack_id int, container string, slot int, part_no int, n_parts int, n_tokens bigint"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a ranks file; it is read on each worker, once."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pack(NamedTuple):
    """One row of pack_specs."""

    pack_id: int
    capacity: int
    separator: int


class Bins:
    """Bounded-space online best-fit over one capacity."""

    def __init__(self, pack: Pack, open_bins: int, label: str) -> None:
        self.pack, self.most, self.label = pack, open_bins, label
        self.mask = 0
        self.by_free: dict[int, list[int]] = {}
        self.slots: dict[int, int] = {}
        self.made = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_no = held.pop()
        if not held:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        return bin_no

    def _put(self, bin_no: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_no)
        self.mask |= 1 << free

    def add(self, size: int) -> tuple[str, int]:
        """The container and slot of an item of at most the capacity."""
        need = size + self.pack.separator
        above = self.mask >> need << need
        if above:
            free = (above & -above).bit_length() - 1
            bin_no = self._take(free)
            left = free - need
        else:
            if len(self.slots) >= self.most:
                fullest = (self.mask & -self.mask).bit_length() - 1
                del self.slots[self._take(fullest)]
            bin_no, self.made = self.made, self.made + 1
            left = self.pack.capacity - size
        slot = self.slots.get(bin_no, 0)
        self.slots[bin_no] = slot + 1
        # Free space 0 can take nothing more but an empty item without separator; it stays searchable.
        self._put(bin_no, left)
        return f"{self.label}-{bin_no}", slot


def parts_of(size: int, capacity: int) -> list[int]:
    """Sizes of the parts of an item; only one above the capacity has several, all full but the last."""
    if size <= capacity:
        return [size]
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * bool(rest)


def pack_texts(documents: DataFrame, packs: list[Pack], tokenizer: str = TOKENIZER, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per part of a document and container kind: :data:`PACKED`.

    ``documents``: doc_id, text. A null or empty text has 0 tokens and still gets a
    place. Containers hold their items' tokens and ``separator`` between two. Rows
    with equal ids are packed as they come; other columns are dropped. Names of
    containers hold the task's number, which is stable for a given set of files.
    ``packs`` is the whole, checked list of container kinds.
    """
    if not packs:
        raise ValueError("no container kinds")
    if len(packs) > 1000 or any(not p.capacity or p.capacity < 1 for p in packs):
        raise ValueError("container kinds need capacities, and at most 1000 are expected")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = [(p, Bins(p, open_bins, f"{p.pack_id}-{task}")) for p in packs]
        count = encoder(tokenizer).encode_ordinary
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                size = len(count(text)) if text else 0
                for p, b in bins:
                    parts = parts_of(size, p.capacity)
                    for no, part in enumerate(parts):
                        name, slot = b.add(part)
                        out.append((doc_id, p.pack_id, name, slot, no, len(parts), part))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])

    return documents.select("doc_id", "text").mapInPandas(pack, PACKED)


def packs_of(specs: DataFrame) -> list[Pack]:
    """The rows of pack_specs, checked to be few."""
    rows = specs.filter("pack_id is not null and capacity_tokens > 0").select("pack_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("s")).distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container kinds")
    return sorted(Pack(r[0], r[1], r[2]) for r in rows)
