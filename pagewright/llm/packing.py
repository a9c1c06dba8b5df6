"""Filling containers of fixed capacity with documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.tokens import TOKENIZERS, token_counts
from pagewright.plans.lineage import materialize, release
from pagewright.plans.skew import small

#: Items of a block, islands of a block, individuals of an island, children of an epoch.
BLOCK, ISLANDS, POPULATION, CHILDREN = 6000, 3, 5, 10
#: Epochs over all items, and over those of containers that were opened again.
EPOCHS, LATER_EPOCHS = 2, 4
#: Containers filled less than this share are opened again, their items go to another level's blocks.
REOPEN_BELOW = 0.996
#: A level must settle this share of a spec's items, or its containers stay as they are: levels grow with the logarithm of the items.
LEAST_SETTLED = 0.05

Solution = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Solution) -> Solution:
    """Put items into bins, each where the least space is left, opening new ones; items in the order given."""
    space = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(space, (sizes[i], -1))
        if at < len(space):
            left, k = space.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        insort(space, (left - sizes[i], k))
    return bins


def fitness(bins: Solution, sizes: list[int], capacity: int) -> float:
    """Mean squared fill: full containers count more than even ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(mother: Solution, father: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Whole well-filled bins of the father go into the mother; her bins that share an item are opened, and what is
    displaced is put back best-fit, large items first."""
    filled = [b for b in father if sum(sizes[i] for i in b) >= 0.985 * capacity] or father
    injected = rng.sample(filled, max(1, int(len(filled) * rng.uniform(0.15, 0.5))))
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in mother:
        if taken.isdisjoint(b):
            kept.append(b[:])
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, kept + [b[:] for b in injected])


def mutate(bins: Solution, sizes: list[int], capacity: int, rng: random.Random) -> Solution:
    """Open the emptiest bins and some others, put their items back best-fit."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    opened = set(order[: max(2, len(order) // 20)]) | set(rng.sample(order, max(1, len(order) // 20)))
    loose = [i for k in opened for i in bins[k]]
    rng.shuffle(loose)
    loose.sort(key=lambda i: sizes[i] * rng.uniform(0.9, 1.0), reverse=True)
    return best_fit(loose, sizes, capacity, [b[:] for k, b in enumerate(bins) if k not in opened])


def at_bound(bins: Solution, sizes: list[int], capacity: int) -> bool:
    """Whether there are as few containers as the sum of sizes allows."""
    return len(bins) * capacity - sum(sizes) < capacity


def first_population(sizes: list[int], capacity: int, rng: random.Random, elites: list[Solution] | None = None) -> list[Solution]:
    """The elites, or else best-fit decreasing, and the same with sizes blurred more and more. One that needs as few
    containers as there can be stays alone."""
    out = list(elites or [])
    for p in range(len(out), POPULATION):
        if out and at_bound(max(out, key=lambda s: fitness(s, sizes, capacity)), sizes, capacity):
            break
        blur = 0.06 * p
        order = sorted(range(len(sizes)), key=lambda i: sizes[i] * rng.uniform(1 - blur, 1), reverse=True)
        out.append(best_fit(order, sizes, capacity, []))
    return out


def evolve(population: list[Solution], sizes: list[int], capacity: int, rng: random.Random) -> list[Solution]:
    """One epoch: children replace the worst individual when they are better; the best one comes first."""
    scored = sorted(((fitness(s, sizes, capacity), s) for s in population), key=lambda x: -x[0])
    for _ in range(CHILDREN):
        if at_bound(scored[0][1], sizes, capacity):
            break
        mother, father = rng.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
        child = crossover(mother[1], father[1], sizes, capacity, rng)
        if rng.random() < 0.4:
            child = mutate(child, sizes, capacity, rng)
        score = fitness(child, sizes, capacity)
        if score > scored[-1][0]:
            scored[-1] = (score, child)
            scored.sort(key=lambda x: -x[0])
    return [s for _, s in scored]


_STATE = "spec_id int, capacity bigint, block bigint, island int, sizes array<bigint>, elite array<array<int>>, fit double"


def _epoch(number: int, level: int):
    """mapInPandas function: islands through one epoch. An island keeps its elite only; the others of its population are
    its neighbour's elite and new ones from a seed."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                sizes = [int(x) for x in row.sizes]
                rng = random.Random(f"{row.spec_id}/{level}/{row.block}/{row.island}/{number}")
                elites = [[[int(i) for i in b] for b in s] for s in (row.elite, row.guest) if s is not None] if number else []
                best = evolve(first_population(sizes, row.capacity, rng, elites), sizes, row.capacity, rng)[0]
                out.append((row.spec_id, row.capacity, row.block, row.island, row.sizes, best, fitness(best, sizes, row.capacity)))
            yield pd.DataFrame(out, columns=["spec_id", "capacity", "block", "island", "sizes", "elite", "fit"])

    return run


def _pack_blocks(items: DataFrame, blocks: DataFrame, level: int, tasks: int) -> DataFrame:
    """Pack each block of items (spec_id, capacity, name, size): spec_id, capacity, block, bin, name, size."""
    placed = items.join(small(blocks), "spec_id").withColumn("block", F.pmod(F.xxhash64("name", F.lit(level)), F.col("n_blocks")))
    # a block holds about BLOCK items whatever the number of items
    grouped = materialize(placed.groupBy("spec_id", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("size", "name"))).alias("i")))
    state = grouped.select("spec_id", "capacity", "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("i.size").alias("sizes"))
    state = materialize(state.repartition(tasks, "spec_id", "block", "island").mapInPandas(_epoch(0, level), _STATE))
    for number in range(1, LATER_EPOCHS if level else EPOCHS):
        elite = state.select("spec_id", "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        before, state = state, materialize(state.join(elite, ["spec_id", "block", "island"], "left").repartition(tasks, "spec_id", "block", "island").mapInPandas(_epoch(number, level), _STATE))
        release(before)
    best = state.groupBy("spec_id", "block").agg(F.max_by("elite", F.struct("fit", -F.col("island"))).alias("elite"))
    bins = grouped.join(best, ["spec_id", "block"]).select("spec_id", "capacity", "block", "i", F.posexplode("elite").alias("bin", "members"))
    rows = bins.select("spec_id", "capacity", "block", "bin", F.explode(F.transform("members", lambda m: F.element_at("i", m + 1))).alias("m"))
    return rows.select("spec_id", "capacity", "block", "bin", "m.name", "m.size")


def pack(items: DataFrame) -> DataFrame:
    """Pack items (spec_id, capacity, name, size <= capacity; name unique in a spec) into containers: spec_id, container_id,
    name, size.

    Items are hashed into blocks of about BLOCK; each block is solved on ISLANDS islands whose elites migrate in a ring
    between epochs. Of a spec with several blocks the containers that stay below REOPEN_BELOW are opened and their items
    packed once more, among those of all blocks, until what is left fits into one block or a level settles less than
    LEAST_SETTLED of it.
    """
    items = materialize(items)
    done: list[DataFrame] = []
    level = 0
    while True:
        counts = items.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
        sizes = {r.spec_id: r.n for r in counts.collect()}  # one row a spec
        if not sizes:
            break
        blocks = counts.select("spec_id", F.ceil(F.col("n") / BLOCK).alias("n_blocks"))
        islands = ISLANDS * sum(-(-n // BLOCK) for n in sizes.values())
        packed = _pack_blocks(items, blocks, level, min(2 * islands, 8 * items.sparkSession.sparkContext.defaultParallelism))
        name = F.concat_ws("-", F.col("spec_id").cast("string"), F.lit(level).cast("string"), F.col("block").cast("string"), F.col("bin").cast("string"))
        fills = F.sum("size").over(Window.partitionBy("spec_id", "block", "bin")) / F.col("capacity")
        packed = materialize(packed.withColumn("fill", fills).withColumn("container_id", name))
        again = packed.where(F.col("fill") < REOPEN_BELOW)
        left = {r.spec_id: r.n for r in again.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        going = [s for s, n in left.items() if sizes[s] > BLOCK and n <= (1 - LEAST_SETTLED) * sizes[s]]
        reopen = (F.col("fill") < REOPEN_BELOW) & F.col("spec_id").isin(going) if going else F.lit(False)
        done.append(packed.where(~reopen).select("spec_id", "container_id", "name", "size"))
        if not going:
            break
        before, items = items, materialize(packed.where(reopen).select("spec_id", "capacity", "name", "size"))
        release(before)
        level += 1
    kinds = items.schema
    out = items.sparkSession.createDataFrame([], f"spec_id int, container_id string, name string, size {kinds['size'].dataType.simpleString()}") if not done else done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def containers(documents: DataFrame, specs: DataFrame, key: str = "doc_id", column: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Documents in containers for each row of specs (spec_id, capacity, tokenizer): spec_id, container_id, key, piece,
    start_token, n_tokens.

    Only documents larger than the capacity are divided: into full pieces, each a container, and a rest that is packed
    like others. Empty and NULL texts go nowhere. Keys must be unique; an empty corpus gives no rows.
    """
    wanted = [r.tokenizer for r in specs.select("tokenizer").distinct().collect()]  # as many as tokenizer files
    counts = None
    for name in wanted:
        one = token_counts(documents, key, column, name, folder).withColumn("tokenizer", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ValueError("no container specification")
    counts = materialize(counts)
    asked = counts.join(small(specs.select("spec_id", F.col("capacity").cast("bigint").alias("capacity"), "tokenizer")), "tokenizer")
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("bigint")
    pieces = asked.select("spec_id", "capacity", key, "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), full)).alias("piece"))
    pieces = pieces.withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("start_token"))).where("size > 0")
    label = F.concat_ws("/", F.col(key).cast("string"), F.col("piece").cast("string"))
    pieces = pieces.withColumn("name", label)
    whole = pieces.where("size = capacity").select("spec_id", F.concat_ws("-", F.col("spec_id").cast("string"), F.lit("full"), F.col("name")).alias("container_id"), "name", "size")
    packed = pack(pieces.where("size < capacity").select("spec_id", "capacity", "name", "size"))
    kind = documents.schema[key].dataType
    parts = F.split("name", "/(?=[0-9]+$)")
    rows = whole.unionByName(packed).withColumn(key, parts[0].cast(kind)).withColumn("piece", parts[1].cast("bigint"))
    specs = specs.select("spec_id", F.col("capacity").cast("bigint").alias("capacity"))
    return rows.join(small(specs), "spec_id").select("spec_id", "container_id", key, "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("size").alias("n_tokens"))
