"""Best-fit packing by merging residues up a tree.

Documents become token pieces of at most ``capacity``.  Pieces are dealt to
buckets; each bucket packs its own best-fit, largest first.  Bins that are
nearly full are done.  The others rise as single items, each as long as its
content, to fewer buckets, where they are packed again by best fit, until
few are left or a round gains nothing.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import WordHasher, byte_groups, checkpointed, free_name, small_batches

CAPACITY = 1024
SEPARATOR = 2
BUCKET_ITEMS = 20_000
GROUP_BYTES = 2 << 20  # texts whose words are encoded together


class WordTokenizer:
    """Token ids of a byte-level BPE, encoding each distinct word of a group of texts once.

    This kind of tokenizer never joins a blank or line break that stands
    alone to what is before it, so a text can be cut there.  Words of a
    group are told apart by 64-bit hashes; the distinct ones are encoded in
    one call, and the ids of all texts are gathered from theirs.  Texts with
    runs of white space, or with some at either end, are encoded as a whole.
    Ids are those of the JSON file's tokenizer: the rank file holds the same
    vocabulary, and the JSON file's added tokens, which the rank file lacks,
    stand for themselves in a text.
    """

    #: The vocabulary's pattern without its rule for runs of white space.
    NO_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, rank_file: str, json_file: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(json_file), "rb") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.any_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        with open(public_tokenizers.path(rank_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.any_text = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.no_runs = tiktoken.Encoding("no_runs", pat_str=self.NO_RUNS, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.hasher = WordHasher(b" \n", fold=False)

    def whole(self, text: str) -> bytes:
        parts = self.any_added.split(text) if self.any_added else [text]
        ids = [i for p in parts for i in ([self.added[p]] if p in self.added else self.any_text.encode_ordinary(p))]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each UTF-8 text."""
        data = b"\n".join(texts)
        raw = np.frombuffer(data, dtype=np.uint8)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1  # where each text's separator stands
        with np.errstate(over="ignore"):
            starts, keys = self.hasher(data)
            cuts = np.searchsorted(starts, np.concatenate(([0], stops)))
            space = (raw == 32) | (raw == 10)
            runs = np.flatnonzero(space[1:] & space[:-1])  # also where a text begins or ends with white space
            plain = np.diff(cuts) > 0
            for at in (runs, runs + 1):
                hit = np.searchsorted(stops, at)
                plain[hit[hit < len(texts)]] = False
            for token in self.added:
                if token.encode() in data:
                    plain &= np.array([token.encode() not in t for t in texts])
            if len(texts) and texts[0][:1] in (b" ", b"\n"):
                plain[0] = False
            if len(texts) and texts[-1][-1:] in (b" ", b"\n"):
                plain[-1] = False
            ends = np.append(starts[1:] - 1, len(raw))
            worded = np.diff(cuts) > 0
            ends[cuts[1:][worded] - 1] = stops[worded]
            keys = keys + (raw[starts - 1] == 10).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        words = None
        while words is None:
            inner = np.repeat(plain, np.diff(cuts))
            inner[cuts[:-1][plain]] = False
            at = np.flatnonzero(inner)
            _, sample, of = np.unique(keys[at], return_index=True, return_inverse=True)
            words = self._encode_words(raw, starts[at[sample]] - 1, ends[at[sample]])
            if words is None:  # some word holds other white space
                plain &= np.array([not self.OTHER_SPACE.search(t.decode()) for t in texts])
        pool, first, count = words
        n = np.zeros(len(starts), dtype=np.int64)
        n[at] = count[of]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(first[of] - total[at], count[of]) + np.arange(total[-1])].tobytes()
        out = []
        for i, text in enumerate(texts):
            if plain[i]:
                a, b = cuts[i], cuts[i + 1]
                out.append(self.whole(data[starts[a] : ends[a]].decode()) + ids[4 * total[a] : 4 * total[b]])
            else:
                out.append(self.whole(text.decode()) if text else b"")
        return out

    def _encode_words(self, raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of byte ranges end to end, with the first place and the number of each range's."""
        ends = np.cumsum(high - low)
        if not len(ends):
            return np.zeros(0, "<u4"), ends, ends
        begins = np.concatenate(([0], ends[:-1]))
        joined = raw[np.repeat(low - begins, high - low) + np.arange(ends[-1])].tobytes().decode()
        if self.OTHER_SPACE.search(joined):
            return None
        ids = np.array(array("I", self.no_runs.encode_ordinary(joined)), dtype="<u4")
        cuts = np.searchsorted(np.cumsum(self.length[ids]), ends) + 1
        first = np.concatenate(([0], cuts[:-1]))
        return ids, first, cuts - first


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, rank_file: str = "byte_bpe_50k.tiktoken", json_file: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each row's ids and a closing separator: doc_id, piece, start, length, ids_crc32.

    Only rows of more than ``capacity`` ids are cut; all pieces but the first
    are then full.  A null text is an empty one: its piece is the separator.
    Texts may be of any length.  A null id is passed on; repeated rows are
    cut each for itself; other columns are not read, whatever their names.
    An empty table gives an empty one.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    tail = np.array([separator], dtype="<u4").tobytes()

    def cut(batches):
        tokens = WordTokenizer(rank_file, json_file)
        for batch in small_batches(batches, GROUP_BYTES):
            at, piece, start, length, crc = [], [], [], [], []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for first, last in byte_groups(texts, GROUP_BYTES):
                for i, ids in enumerate(tokens.encode(texts[first:last]), first):
                    ids += tail
                    n = len(ids) // 4
                    low, high, k = 0, n % capacity or min(n, capacity), 0
                    while low < n:
                        at.append(i), piece.append(k), start.append(low), length.append(high - low)
                        crc.append(zlib.crc32(ids[4 * low : 4 * high]))
                        low, high, k = high, high + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()), pa.array(length, type=pa.int64()), pa.array(crc, type=pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fill.

    A bit for every free space that some bin has finds the tightest bin.
    """
    of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: dict[int, list[int]] = {}
    spaces = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                spaces &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        of[i], offset[i] = b, fill[b]
        fill[b] += size
        left = free - size
        if left:
            open_bins.setdefault(left, []).append(b)
            spaces |= 1 << left
    return of, offset, fill


def _pack_round(items: DataFrame, buckets: int, capacity: int, level: int) -> DataFrame:
    """Packs ``item, length`` bucket by bucket: adds ``bin``, ``offset`` and the bin's fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        of, offset, fill = best_fit(pdf["length"].to_numpy(), capacity)
        # a bin is named by its first item, so names are unique without a counter
        first = pd.Series(pdf["item"].to_numpy()).groupby(of).first().to_numpy()
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "bin": first[of], "offset": offset, "fill": np.array(fill)[of]})

    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(pack, "item long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 4, fan_in: int = 8, min_gain: float = 0.002) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Bins with at most ``slack`` free are emitted after a round.  Buckets hold
    about ``BUCKET_ITEMS`` items at every level, so no task grows with the
    input; where bins cannot be merged (a round saves less than ``min_gain``
    of them) they are emitted as they are.  Repeated rows are packed each for
    itself.  Input columns named ``sequence_id`` or ``offset`` are replaced;
    others pass, whatever their names.  An empty table gives an empty one.
    Only item numbers and lengths are shuffled between rounds.
    """
    pieces = pieces.drop("sequence_id", "offset")
    number = free_name(pieces, "_item")
    kept = checkpointed(pieces.withColumn(number, F.monotonically_increasing_id()))
    rows = kept.select(F.col(number).alias("item"), "length")
    whole = rows.where(F.col("length") >= capacity).select("item", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    items = rows.where(F.col("length") < capacity).select("item", "length")
    n = items.count()
    buckets = max(1, -(-n // BUCKET_ITEMS))
    done, chain, level = [whole], None, 0
    while n:
        packed = checkpointed(_pack_round(items, buckets, capacity, level))
        # where each original item is now: its bin, and its place there
        here = packed.select(F.col("item").alias("via"), "bin", F.col("offset").alias("within"), "fill")
        if chain is None:
            chain = here.select(F.col("via").alias("item"), "bin", F.col("within").alias("offset"), "fill")
        else:
            chain = chain.withColumnRenamed("bin", "via").drop("fill").join(here, "via").select("item", "bin", (F.col("offset") + F.col("within")).alias("offset"), "fill")
        chain = checkpointed(chain)
        left = packed.where(F.col("fill") < capacity - slack).groupBy("bin").agg(F.max("fill").alias("length"))
        m = left.count()
        final = m <= 1 or buckets == 1 and level > 0 or level > 0 and m > n * (1 - min_gain)
        done.append((chain if final else chain.where(F.col("fill") >= capacity - slack)).select("item", "bin", "offset"))
        if final:
            break
        chain = chain.where(F.col("fill") < capacity - slack)
        items, n, level = left.select(F.col("bin").alias("item"), "length"), m, level + 1
        buckets = max(-(-m // BUCKET_ITEMS), min(buckets // fan_in, -(-m // 2000)), 1)
    placed = done[0]
    for more in done[1:]:
        placed = placed.union(more)
    placed = placed.select(F.col("item").alias(number), F.col("bin").alias("sequence_id"), "offset")
    return kept.join(placed, number).drop(number)
