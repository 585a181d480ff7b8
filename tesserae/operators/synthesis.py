"""Routes over a reaction table: what an item costs to make, its cheapest derivations, and their steps.

A reaction makes a product of reactants; an item is made by one of its reactions (or) from all of their reactants (and), or bought.
Prices are relaxed in rounds: a reaction's price is its own and those of its reactants, an item's the least of its
reactions' and its shelf price; a round is two joins and two aggregates over the reactions, and rounds end when no price falls.
Costs are above 0, so a cheapest derivation never makes an item from itself. For the k best each item keeps its k cheapest
derivations with their steps; one that would make an item from itself is dropped. On tables without cycles these are the k
cheapest exactly; with cycles, derivations beyond an item's k are not tried in place of dropped ones (the first is exact).

Null prices, costs, items and reactions without reactants are left out; a reactant that a reaction names twice is paid for twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import discard, written


def _clean(reactions: DataFrame) -> DataFrame:
    ok = F.col("reaction").isNotNull() & F.col("product").isNotNull() & F.col("cost").isNotNull() & (F.size("reactants") > 0) & ~F.exists("reactants", lambda x: x.isNull())
    return reactions.filter(ok).select("reaction", "product", "reactants", F.col("cost").cast("double").alias("cost"))


def prices(reactions: DataFrame, stock: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(item, price, reaction, depth): the least price of every item that can be bought or made by ``reactions`` (reaction,
    product, reactants, cost > 0) from ``stock`` (item, price); reaction is null for what is bought. Of equal prices the purchase and
    then the least reaction is taken. With ``max_depth`` only derivations of so many reactions in a row count."""
    made = written(_clean(reactions), "reactions")
    each = written(made.select("reaction", F.explode("reactants").alias("_item")), "reactants")
    sizes = made.select("reaction", "product", "cost", F.size("reactants").alias("_need"))
    bought = stock.filter(F.col("item").isNotNull() & F.col("price").isNotNull()).groupBy("item").agg(F.min(F.col("price").cast("double")).alias("price"))
    kind = made.schema["reaction"].dataType
    now = written(bought.select("item", "price", F.lit(None).cast(kind).alias("reaction"), F.lit(0).alias("depth")), "prices")
    rounds = 0
    while max_depth is None or rounds < max_depth:
        rounds += 1
        paid = each.join(now.select(F.col("item").alias("_item"), "price", "depth"), "_item").groupBy("reaction").agg(F.sum("price").alias("_sum"), F.count(F.lit(1)).alias("_have"), F.max("depth").alias("_deep"))
        offers = paid.join(sizes, "reaction").filter(F.col("_have") == F.col("_need"))
        offers = offers.select(F.col("product").alias("item"), (F.col("cost") + F.col("_sum")).alias("price"), "reaction", (F.col("_deep") + 1).alias("depth"))
        best = offers.unionByName(now).groupBy("item").agg(F.min_by(F.struct("price", "reaction", "depth"), F.struct("price", F.col("reaction").isNotNull(), "reaction")).alias("_b"))
        after = written(best.select("item", "_b.price", "_b.reaction", "_b.depth"), "prices")
        old = now.select(F.col("item").alias("_i"), F.col("price").alias("_p"))
        fell = not after.join(old, F.col("item") == F.col("_i"), "left").filter(F.col("_p").isNull() | (F.col("price") < F.col("_p"))).isEmpty()
        discard(now)
        now = after
        if not fell:
            break
    return now


_STEP = "struct<reaction:{r},product:{i}>"


def _combined(lists: Column, cost: Column, product: Column, reaction: Column, k: int, step: str) -> Column:
    """The k cheapest choices of a derivation for each reactant: one reactant after the other is added, k choices kept at most."""
    start = F.array(F.struct(cost.alias("price"), F.array(F.struct(reaction.alias("reaction"), product.alias("product"))).cast(f"array<{step}>").alias("steps"), F.lit(0).alias("depth")))

    def add(so_far: Column, options: Column) -> Column:
        both = F.flatten(
            F.transform(so_far, lambda a: F.transform(options, lambda b: F.struct((a["price"] + b["price"]).alias("price"), F.concat(a["steps"], b["steps"]).alias("steps"), F.greatest(a["depth"], b["depth"]).alias("depth"))))
        )
        return F.slice(F.array_sort(both), 1, k)

    return F.aggregate(lists, start, add)


def _worth(each: DataFrame, now: DataFrame, shelf: DataFrame, k: int) -> DataFrame:
    """(reaction): those that can give one of the k cheapest derivations of their product, found from prices alone, so that steps
    travel only for them. k reactions of which no choice comes back to the product, or the purchase, bound the k-th price."""
    options = now.select(F.col("item").alias("_item"), F.get("_best", F.lit(0))["price"].alias("_p"), F.array_distinct(F.flatten(F.transform("_best", lambda o: F.transform(o["steps"], lambda s: s["product"])))).alias("_through"))
    met = each.join(options, "_item").select("reaction", "product", "_need", "cost", "_p", F.array_contains("_through", F.col("product")).alias("_back"))
    paid = met.groupBy("reaction", "product", "_need", "cost").agg(F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_have"), F.max("_back").alias("_back"))
    offers = paid.filter("_have = _need").select("reaction", F.col("product").alias("item"), (F.col("cost") + F.col("_sum")).alias("_p"), "_back")
    offers = written(offers, "offers")
    sure = offers.filter("NOT _back").select("item", "_p").unionByName(shelf.select("item", F.get("_best", F.lit(0))["price"].alias("_p")))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("_p"))
    bound = sure.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy("item").agg(F.max("_p").alias("_bound"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == k)
    # prices added in another order may differ by rounding
    near = F.col("_bound").isNull() | (F.col("_p") <= F.col("_bound") + 1e-9 * (1 + F.abs("_bound")))
    return offers.join(bound, "item", "left").filter(near).select("reaction")


def routes(reactions: DataFrame, stock: DataFrame, k: int = 5, max_depth: int = 10) -> DataFrame:
    """(item, rank, price, depth, n_steps, steps): the k cheapest derivations of every item, the purchase among them (no steps);
    steps are (reaction, product), the last one first."""
    made = written(_clean(reactions), "reactions")
    kinds = made.schema["reaction"].dataType.simpleString(), made.schema["product"].dataType.simpleString()
    step = _STEP.format(r=kinds[0], i=kinds[1])
    option = f"array<struct<price:double,steps:array<{step}>,depth:int>>"
    bought = stock.filter(F.col("item").isNotNull() & F.col("price").isNotNull()).groupBy("item").agg(F.min(F.col("price").cast("double")).alias("_p"))
    shelf = written(bought.select("item", F.array(F.struct(F.col("_p").alias("price"), F.array().cast(f"array<{step}>").alias("steps"), F.lit(0).alias("depth"))).cast(option).alias("_best")), "shelf")
    each = written(made.select("reaction", "product", F.size("reactants").alias("_need"), "cost", F.posexplode("reactants").alias("_i", "_item")), "reactants")
    now = shelf
    for _ in range(max_depth):
        some = each.join(_worth(each, now, shelf, k), "reaction", "left_semi").select("reaction", "_i", "_item")
        known = some.join(now.select(F.col("item").alias("_item"), "_best"), "_item").groupBy("reaction").agg(F.collect_list(F.struct("_i", "_best")).alias("_lists"))  # as many as a reaction has reactants
        met = known.join(made, "reaction").filter(F.size("_lists") == F.size("reactants"))
        lists = F.transform(F.array_sort("_lists"), lambda x: x["_best"])
        combos = met.select(F.col("product").alias("item"), F.explode(_combined(lists, F.col("cost"), F.col("product"), F.col("reaction"), k, step)).alias("_o"))
        # the first step is this reaction; the product must not come up again
        sound = combos.filter(F.size(F.filter("_o.steps", lambda s: s["product"] == F.col("item"))) == 1)
        deeper = sound.select("item", F.struct(F.col("_o.price").alias("price"), F.col("_o.steps").alias("steps"), (F.col("_o.depth") + 1).alias("depth")).alias("_o"))
        every = deeper.unionByName(shelf.select("item", F.explode("_best").alias("_o")))
        order = Window.partitionBy("item").orderBy("_o.price", "_o.steps")
        best = every.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).groupBy("item").agg(F.array_sort(F.collect_list("_o")).cast(option).alias("_best"))
        after = written(best, "derivations")
        changed = not after.exceptAll(now).isEmpty()
        now = after
        if not changed:
            break
    out = now.select("item", F.posexplode("_best").alias("_i", "_o"))
    return out.select("item", (F.col("_i") + 1).alias("rank"), "_o.price", "_o.depth", F.size("_o.steps").alias("n_steps"), "_o.steps")


def route_steps(found: DataFrame, reactions: DataFrame) -> DataFrame:
    """(item, rank, step, reaction, product, reactants): a row for each step of a route, the last reaction first."""
    each = found.select("item", "rank", F.posexplode("steps").alias("_i", "_s")).select("item", "rank", (F.col("_i") + 1).alias("step"), "_s.reaction", "_s.product")
    return each.join(reactions.select("reaction", "reactants"), "reaction").select("item", "rank", "step", "reaction", "product", "reactants")


def route_metrics(found: DataFrame, reactions: DataFrame, confidence: str | None = None) -> DataFrame:
    """(item, rank, price, n_steps, n_joins, convergence, n_blocks, route_type and, with a column of the reactions, the mean
    confidence): a join is a step with more than one reactant; blocks are distinct reactants that no step of the route makes."""
    from tesserae.operators.routes import convergence

    extra = [F.col(confidence).alias("_conf")] if confidence else []
    each = found.select("item", "rank", F.explode("steps").alias("_s"), F.transform("steps", lambda s: s["product"]).alias("_made"))
    met = each.join(reactions.select(F.col("reaction").alias("_r"), "reactants", *extra), F.col("_s.reaction") == F.col("_r"))
    blocks = F.size(F.array_distinct(F.flatten(F.collect_list(F.array_except("reactants", "_made")))))
    stats = [F.count(F.lit(1)).alias("n_steps"), F.count_if(F.size("reactants") > 1).alias("n_joins"), blocks.alias("n_blocks"), *([F.avg("_conf").alias("confidence")] if confidence else [])]
    made = met.groupBy("item", "rank").agg(*stats)
    out = found.select("item", "rank", "price").join(made, ["item", "rank"])
    kind = F.when(F.col("n_joins") == 0, "linear").otherwise("convergent")
    return out.withColumns({"convergence": convergence(F.col("n_steps"), F.col("n_joins")), "route_type": kind})
