"""Texts packed into containers of fixed capacity by lexical retrieval.

Sizes are tokens of a public tokenizer, counted once for all capacities. A text larger than the capacity is
cut into full pieces, each a container of its own, and a rest; no other text is split. What is packed travels
with its bag: every distinct token and how often it occurs, a rest with its own tokens only. Pieces are put in
order of the two smallest hashes of their tokens and cut into shards, so that neighbours meet in one shard
however many there are; each shard is scored by BM25, with the document frequencies of the whole corpus. A
seed (the largest piece left) opens a container, its tokens retrieve unused neighbours, and these fill the
window greedily by score. What room they leave is filled by the largest unused piece that fits. Containers
that stay poorly filled give their pieces to a second round of larger shards.

Edge cases: null and empty texts take no container; ties of score go to the smaller id; repeated ids are
packed as often as they occur; shards are about SHARD pieces, whatever the skew of the data: equal sketches, and
even equal rows, are parted by their number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.runtime import cut

SHARD = 2_000
#: A container less full than this is packed again.
POOR = 0.97
K1, B = 1.2, 0.75
# Fixed value: how the byte-level vocabularies cut a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """A function from texts to lists of token ids. path: a .tiktoken file of ranks, a tokenizers .json or a sentencepiece .model."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        own = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: s.encode(texts, num_threads=1)


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, the last of a number below 128, and how many bytes each takes."""
    n = 1 + sum((x >> 7 * k > 0).astype(int) for k in range(1, 5))
    starts = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        more = n > k
        out[starts[more] + k] = (x[more] >> 7 * k & 127) | ((n[more] > k + 1) << 7)
    return out, n


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _varints(), and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.zeros(0, int), ends
    starts = np.append(0, ends[:-1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(int) << 7 * place, starts), ends


def bags(parts: Sequence[Sequence[int]]) -> tuple[list[bytes], list[int]]:
    """Every distinct token of each part and how often it occurs, as bytes, and the two smallest hashes of its tokens in one number."""
    sizes = np.array([len(p) for p in parts], int)
    ids = np.fromiter((t for p in parts for t in p), int, int(sizes.sum()))
    pair, counts = np.unique(np.repeat(np.arange(len(parts)), sizes) << 32 | ids, return_counts=True)
    part, token = pair >> 32, pair & 0xFFFFFFFF
    ends = np.cumsum(np.bincount(part, minlength=len(parts)))
    first = np.diff(part, prepend=-1) > 0
    step = np.where(first, token, np.diff(token, prepend=0))
    data, width = _varints(np.column_stack([step, counts]).ravel())
    at = np.append(0, np.cumsum(width))[2 * np.append(0, ends)].tolist()
    data = data.tobytes()
    h = np.sort(part << 32 | token * 2654435761 & 0xFFFFFFFF) & 0xFFFFFFFF  # an odd factor: no two tokens have one hash
    least = [h[a] << 31 | (h[a + 1] >> 1 if b > a + 1 else 0) if b > a else 0 for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return [data[a:b] for a, b in zip(at, at[1:])], [int(x) for x in least]


def unpacked(column: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct tokens each of the bags has, and of all bags in turn the tokens and their counts."""
    values, ends = _numbers(np.frombuffer(b"".join(column), np.uint8))
    own = np.searchsorted(ends, np.cumsum([len(x) for x in column]), "right") // 2
    sizes = np.diff(own, prepend=0)
    step, counts = values[::2], values[1::2]
    total = np.append(0, np.cumsum(step))
    return sizes, total[1:] - np.repeat(total[own - sizes], sizes), counts


_SIZED = "item string, n_tokens int, capacity int, near long, bag binary"


def sized(texts: DataFrame, tokenizer: str, id_col: str = "doc_id", capacities: Iterable[int] = ()) -> DataFrame:
    """item (the id as text), n_tokens, near and bag of every text that isn't empty, at capacity 0; and near and bag of what a capacity's full pieces leave of a larger text."""
    wanted = sorted(set(capacities))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                items, contents = (c.to_pylist() for c in batch.slice(at, 256).columns)
                rows, parts = [], []
                for item, ids in zip(items, encode(contents)):
                    rows.append((item, max(1, len(ids)), 0))
                    parts.append(ids)
                    for c in wanted:
                        if len(ids) > c and len(ids) % c:
                            rows.append((item, len(ids), c))
                            parts.append(ids[len(ids) - len(ids) % c :])
                bag, near = bags(parts)
                item, n, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(n, pa.int32()), pa.array(c, pa.int32()), pa.array(near, pa.int64()), pa.array(bag, pa.binary())], ["item", "n_tokens", "capacity", "near", "bag"])

    return texts.where(F.length("text") > 0).select(F.col(id_col).cast("string").alias("item"), "text").mapInArrow(size, _SIZED)


def cut_to(sizes: DataFrame, capacity: int) -> DataFrame:
    """item, piece, start, tokens, near, bag of each piece: the whole text, or cuts of `capacity` tokens (the bag of a full piece is the whole text's and isn't used). sizes: sized() for this capacity."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("capacity") == capacity
    first, last = F.when(rest, full).otherwise(0), F.when(rest, full).when(F.col("n_tokens") <= capacity, 0).otherwise(full - 1)
    return sizes.where(rest | (F.col("capacity") == 0)).select("item", "n_tokens", "near", "bag", F.explode(F.sequence(first, last)).alias("piece")).select(
        "item", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("tokens"), "near", "bag"
    )


def pieces(texts: DataFrame, capacity: int, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """item, piece, start, tokens of each piece of the texts."""
    return cut_to(sized(texts, tokenizer, id_col, [capacity]), capacity).drop("near", "bag")


def inverse_frequencies(sizes: DataFrame) -> np.ndarray:
    """BM25's inverse document frequency of every token, by its id, over all texts of sized(). As long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, int)
        for batch in batches:
            own = np.bincount(unpacked(batch.column(0).to_pylist())[1], minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])

    whole = sizes.where("capacity = 0")
    seen = whole.select("bag").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(max((r.token for r in seen), default=0) + 1)
    for r in seen:
        df[r.token] = r.n
    return np.log(1 + (whole.count() - df + 0.5) / (df + 0.5))


def _fill(near: np.ndarray, score: np.ndarray, rank: np.ndarray, sizes: np.ndarray, room: int, first: int = 64) -> list[int]:
    """What of near is taken by falling score, then rank, each if it still fits: the best are put in order first, of the others only what has room."""
    taken: list[int] = []
    while len(near := near[sizes[near] <= room]):
        own = score[near]
        least = np.partition(own, -first)[-first] if len(near) > 2 * first else 0
        best = near[own >= least]
        for k, size in zip((best := best[np.lexsort((rank[best], -score[best]))]).tolist(), sizes[best].tolist()):
            if size <= room:
                taken.append(k)
                room -= size
        near = near[own < least]
    return taken


def pack_shard(keys: list, sizes: np.ndarray, terms: list, counts: list, capacity: int, idf: np.ndarray | None = None, mean: float | None = None) -> list[list[int]]:
    """Containers as lists of positions: seeds by falling size, neighbours by BM25, then the largest that still fits.

    idf: of every term; mean: tokens of a piece. Where they are not given, the shard's own are taken.
    """
    n = len(sizes)
    order = sorted(range(n), key=lambda k: (-int(sizes[k]), keys[k]))
    rank = np.empty(n, int)
    rank[sorted(range(n), key=lambda k: keys[k])] = np.arange(n)
    free = np.ones(n, bool)
    by_size = np.array(sorted(range(n), key=lambda k: (int(sizes[k]), rank[k])), int)
    sorted_sizes = sizes[by_size]
    # all terms of all pieces by rising size: what fits in a window is the head of it; a piece of no terms has one of no weight
    lengths = np.array([len(terms[k]) for k in by_size], int)
    flat = np.concatenate([np.asarray(terms[k], int) for k in by_size]) if n else np.zeros(0, int)
    tf = np.concatenate([np.asarray(counts[k], float) for k in by_size]) if n else np.zeros(0)
    if n and not lengths.all():
        at = (np.cumsum(lengths) - lengths)[lengths == 0]
        flat, tf, lengths = np.insert(flat, at, -1), np.insert(tf, at, 0.0), np.maximum(lengths, 1)
    names, word, df = np.unique(flat, return_inverse=True, return_counts=True)
    own_idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if idf is None else idf[names]
    starts = np.cumsum(lengths) - lengths
    length = np.maximum(1.0, np.add.reduceat(tf, starts)) if n else tf
    weight = own_idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.repeat(length, lengths) / (mean or length.mean()))) if n else tf
    words = [None] * n
    for k, own in zip(by_size, np.split(word, starts[1:]) if n else []):
        words[k] = own
    asked, shared, score = np.zeros(len(names)), np.empty(len(word)), np.zeros(n)
    live, left = by_size, n
    done, low = [], 0
    for seed in order:
        if not free[seed]:
            continue
        free[seed] = False
        left -= 1
        held, room = [seed], capacity - int(sizes[seed])
        while low < n and not free[by_size[low]]:
            low += 1
        if low < n and room >= sorted_sizes[low]:
            if left < 0.8 * len(live):  # what is packed leaves the index
                keep = free[live]
                rows = np.repeat(keep, lengths)
                word, weight, live, lengths = word[rows], weight[rows], live[keep], lengths[keep]
                starts = np.cumsum(lengths) - lengths
            m = int(np.searchsorted(sizes[live], room, "right"))
            end = int(starts[m]) if m < len(live) else len(word)
            asked[words[seed]] = 1
            np.multiply(asked.take(word[:end], out=shared[:end], mode="clip"), weight[:end], out=shared[:end])
            asked[words[seed]] = 0
            near = live[:m]
            score[near] = np.add.reduceat(shared[:end], starts[:m])
            for k in _fill(near[free[near] & (score[near] > 0)], score, rank, sizes, room):
                free[k] = False
                held.append(k)
                room -= int(sizes[k])
            while True:
                fits = by_size[low : int(np.searchsorted(sorted_sizes, room, "right"))]
                fits = fits[free[fits]]
                if not len(fits):
                    break
                k = int(fits[-1])
                free[k] = False
                held.append(k)
                room -= int(sizes[k])
            left -= len(held) - 1
        done.append(held)
    return done


_PACKED = "item string, piece int, start int, tokens int, near long, bag binary, container string, used int, position int"


def _round(rest: DataFrame, capacity: int, shard: int, name: str, idf: np.ndarray, poor: float = 0.0) -> DataFrame:
    """The pieces of a table that is read alike every time in containers, with what the container holds; bags of the poorly filled only."""
    n, tokens = rest.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    shards, mean = max(1, -(-n // shard)), (tokens or 0) / max(1, n)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := list(batches)):
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        if not len(rows):
            return
        own = TaskContext.get().partitionId()
        keys = list(zip(rows["item"].to_pylist(), rows["piece"].to_pylist()))
        sizes = rows["tokens"].to_numpy()
        each, terms, counts = unpacked(rows["bag"].to_pylist())
        at = np.cumsum(each)[:-1]
        packed = pack_shard(keys, sizes, np.split(terms, at), np.split(counts, at), capacity, idf, mean)
        held = [(f"{name}-{own}-{c}", int(sizes[h].sum()), p, k) for c, h in enumerate(packed) for p, k in enumerate(h)]
        container, used, position, taken = zip(*held)
        out, used = rows.take(pa.array(taken)), pa.array(used, pa.int32())
        bag = pc.if_else(pc.less(used, capacity * poor), out["bag"], pa.scalar(None, out["bag"].type))
        out = out.set_column(out.schema.get_field_index("bag"), "bag", bag)
        yield from out.append_column("container", pa.array(container)).append_column("used", used).append_column("position", pa.array(position, pa.int32())).to_batches()

    columns = ["item", "piece", "start", "tokens", "near", "bag"]
    numbered = rest.select(*columns, F.monotonically_increasing_id().alias("no"))
    return numbered.repartitionByRange(shards, "near", "item", "no").drop("no").mapInArrow(fill, _PACKED)


def pack_sized(sizes: DataFrame, capacity: int, idf: np.ndarray, shard: int = SHARD, poor: float = POOR) -> DataFrame:
    """container, item, piece, start, tokens, position: every piece of checkpointed sized() texts in exactly one container of `capacity` tokens. idf: inverse_frequencies()."""
    every = cut_to(sizes, capacity)
    columns = ["container", "item", "piece", "start", "tokens", "position"]
    full = every.where(F.col("tokens") == capacity).withColumn("container", F.concat(F.lit("f-"), F.monotonically_increasing_id())).withColumn("position", F.lit(0))
    first = cut(_round(every.where(F.col("tokens") < capacity), capacity, shard, "a", idf, poor))
    weak = F.col("used") < capacity * poor
    second = _round(first.where(weak), capacity, shard * 2, "b", idf)
    return full.select(*columns).unionByName(first.where(~weak).select(*columns)).unionByName(second.select(*columns))


def pack(texts: DataFrame, capacity: int, tokenizer: str, id_col: str = "doc_id", shard: int = SHARD, poor: float = POOR) -> DataFrame:
    """container, item, piece, start, tokens, position: every piece in exactly one container of `capacity` tokens."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = cut(sized(texts, tokenizer, id_col, [capacity]))
    return pack_sized(sizes, capacity, inverse_frequencies(sizes), shard, poor)


def pack_kinds(texts: DataFrame, containers: DataFrame, tokenizer: str, id_col: str = "doc_id", most_kinds: int = 1000) -> DataFrame:
    """container_kind beside pack()'s columns, for every kind of containers (container_kind, capacity_tokens); kinds without a capacity are left out.

    The kinds are a stated list, each a packing of its own: more than most_kinds are refused.
    """
    kinds = containers.where(F.col("container_kind").isNotNull() & (F.col("capacity_tokens") >= 1)).select("container_kind", "capacity_tokens").distinct().orderBy("container_kind", "capacity_tokens").take(most_kinds + 1)
    if len(kinds) > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of containers")
    sizes = cut(sized(texts, tokenizer, id_col, [r.capacity_tokens for r in kinds]))  # tokens are counted once for all kinds
    idf = inverse_frequencies(sizes) if kinds else None
    packed = None
    for r in kinds:
        own = pack_sized(sizes, r.capacity_tokens, idf).select(F.lit(r.container_kind).alias("container_kind"), "container", "item", "piece", "start", "tokens", "position")
        packed = own if packed is None else packed.unionByName(own)
    if packed is None:
        return sizes.select(*[F.lit("").alias(c) for c in ("container_kind", "container")], "item", *[F.lit(0).alias(c) for c in ("piece", "start", "tokens", "position")]).where(F.lit(False))
    return packed


def fill_rates(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_tokens, fill: how much of the containers' room is used."""
    return packed.agg(F.count_distinct("container").alias("n_containers"), F.sum("tokens").alias("n_tokens")).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * capacity))
