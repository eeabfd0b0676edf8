"""Joins and set operations on whole tables: visibility, reconciliation, multisets, intervals, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In the column user_id of what is visible, a null stands for everyone.
EVERYONE = None
#: Parts that the assets of every workspace are dealt over where they meet its members.
DEALT = 64


def visible_workspaces(workspaces: DataFrame, memberships: DataFrame, users: DataFrame) -> DataFrame:
    """P2/V9. Distinct (user_id, workspace_id) that users own or joined. Both sides are cut to the users before the union."""
    own = workspaces.select(F.col("owner_id").alias("user_id"), "workspace_id").join(users, "user_id", "left_semi")
    return own.union(memberships.select("user_id", "workspace_id").join(users, "user_id", "left_semi")).distinct()


def visible_classes(assets: DataFrame, workspaces: DataFrame, memberships: DataFrame, grants: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1/P3 without pairs of assets and members: what is visible, each (user_id, asset_id) once, as rooms (asset_id, workspace_id),
    members (user_id, workspace_id) and single (user_id, asset_id) that no member's room gives. rooms joined with members, and
    single, are disjoint, so sums over them need no distinct pairs. Arguments as those of visible.

    An asset of one workspace has one room; one of several, or without an id, stands among the single, with all that see it."""
    members = visible_workspaces(workspaces, memberships, users)
    # one aggregation, which combines before its shuffle, tells assets of one workspace from those of several
    per = assets.where("asset_id is not null and workspace_id is not null").groupBy("asset_id").agg(F.min("workspace_id").alias("workspace_id"), F.max("workspace_id").alias("_last"))
    rooms = per.where("workspace_id = _last").select("asset_id", "workspace_id")
    several = per.where("workspace_id <> _last").select("asset_id")
    several = assets.join(several, "asset_id", "left_semi").select("asset_id", "workspace_id").union(assets.where("asset_id is null").select("asset_id", "workspace_id"))
    shared = several.distinct().join(members, "workspace_id").select("user_id", "asset_id")
    own = assets.select(F.col("owner_id").alias("user_id"), "asset_id").join(users, "user_id", "left_semi")
    scoped = grants.join(assets.select("asset_id"), "asset_id", "left_semi")
    given = scoped.where("grantee_id is not null").select(F.col("grantee_id").alias("user_id"), "asset_id").join(users, "user_id", "left_semi").select("user_id", "asset_id")
    public = scoped.where("grantee_id is null").select(F.lit(EVERYONE).cast(users.schema["user_id"].dataType).alias("user_id"), "asset_id")
    single = own.union(given).union(shared).union(public).distinct()
    single = single.join(rooms, "asset_id", "left").join(members, ["user_id", "workspace_id"], "left_anti").select("user_id", "asset_id")
    return rooms, members, single


def visible(assets: DataFrame, workspaces: DataFrame, memberships: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """P1/P3/U1/J7. Distinct (user_id, asset_id): own assets, those of a workspace that the user owns or joined, those granted to
    the user, and those granted to all (a null grantee), which come once with a null user_id instead of once a user. assets:
    asset_id, owner_id, workspace_id, those in scope; grants: asset_id, grantee_id. A union of equi-joins, so that no disjunction
    forces a nested loop, of disjoint parts, so that pairs are never shuffled; the assets of each workspace are dealt out."""
    rooms, members, single = visible_classes(assets, workspaces, memberships, grants, users)
    # a fixed number, as adaptive execution would put these small sides, which make many pairs, into a few tasks
    n = max(DEALT, int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = rooms.withColumn("_deal", F.pmod(F.xxhash64("asset_id"), F.lit(DEALT)).cast("int")).repartition(n, "workspace_id", "_deal")
    m = members.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).repartition(n, "workspace_id", "_deal")
    return r.join(m, ["workspace_id", "_deal"]).select("user_id", "asset_id").union(single)


def visible_chunks(chunks: DataFrame, assets_visible: DataFrame, users: DataFrame) -> DataFrame:
    """P4/P5. Distinct (user_id, chunk_id): chunks (chunk_id, asset_id, owner_id) of visible assets, own ones, and public ones, which
    have neither asset nor owner (null user_id). Assets out of scope are not among the visible, so their chunks are not."""
    of_asset = chunks.where("asset_id is not null").join(assets_visible, "asset_id").select("user_id", "chunk_id")
    return of_asset.union(_chunks_without_asset(chunks, users)).distinct()


def _chunks_without_asset(chunks: DataFrame, users: DataFrame) -> DataFrame:
    own = chunks.where("asset_id is null and owner_id is not null").select(F.col("owner_id").alias("user_id"), "chunk_id").join(users, "user_id", "left_semi")
    public = chunks.where("asset_id is null and owner_id is null").select(F.lit(EVERYONE).cast(users.schema["user_id"].dataType).alias("user_id"), "chunk_id")
    return own.union(public)


def visible_chunk_totals(chunks: DataFrame, classes: tuple[DataFrame, DataFrame, DataFrame], users: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """P4/P5. What visible_chunks has of each user: user_id, chunks (their number) and the sums of whole numbers of chunk_id, by name;
    classes as visible_classes gives them. Chunks are summed by asset and assets by workspace, so a member takes one row of a
    workspace and no pair of user and chunk is made. A chunk_id belongs to one asset, or to none."""
    total = lambda d, *keys: d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("chunks", *sums)])
    count = lambda d: d.select(*[c for c in d.columns if c != "chunk_id"], F.lit(1).cast("long").alias("chunks"), *[c.cast("long").alias(n) for n, c in sums.items()])
    rooms, members, single = classes
    of_asset = total(count(chunks.where("asset_id is not null").select("asset_id", "chunk_id").distinct()), "asset_id")
    of_room = total(rooms.join(of_asset, "asset_id"), "workspace_id")
    parts = [members.join(of_room, "workspace_id"), single.join(of_asset, "asset_id"), count(_chunks_without_asset(chunks, users).distinct())]
    return total(parts[0].select("user_id", "chunks", *sums).unionByName(parts[1].select("user_id", "chunks", *sums)).unionByName(parts[2]), "user_id")


def public_or_own(rows: DataFrame, users: DataFrame) -> DataFrame:
    """P13. Rows without a user_id, for everyone, and each user's own."""
    return rows.where("user_id is null").unionByName(rows.join(users, "user_id", "left_semi"))


def admitted(rows: DataFrame, bans: DataFrame, keys: list[str]) -> DataFrame:
    """P21/J8. Rows without a ban."""
    return rows.join(bans, keys, "left_anti")


def reconciled(stored: DataFrame, wanted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """J19. keys and action: delete, insert, update or keep, by a full outer join."""
    s = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_s"))
    w = wanted.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_w"))
    action = F.when(F.col("_w").isNull(), "delete").when(F.col("_s").isNull(), "insert").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return s.join(w, keys, "full_outer").select(*keys, action.alias("action"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3. Rows of either side that the other lacks, with their side and surplus; none: equal multisets."""
    cols = a.columns
    one = a.withColumn("_d", F.lit(1)).union(b.select(*cols).withColumn("_d", F.lit(-1)))
    return one.groupBy(*cols).agg(F.sum("_d").alias("surplus")).where("surplus <> 0").withColumn("side", F.when(F.col("surplus") > 0, "left").otherwise("right"))


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """J21/J11. Pairs of intervals [s, e] of one key that overlap: left_id, right_id.

    Intervals are dealt over buckets of that width, so the join is an equi-join on key and bucket; a pair is kept only in the
    bucket where the overlap begins.
    """
    dealt = lambda d, p: d.select(key, F.col("id").alias(f"{p}_id"), F.col("s").alias(f"{p}s"), F.col("e").alias(f"{p}e"), F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))).alias("_b"))
    j = dealt(left, "left").join(dealt(right, "right"), [key, "_b"]).where("lefts <= righte and rights <= lefte")
    return j.where(F.floor(F.greatest("lefts", "rights") / bucket) == F.col("_b")).select(key, "left_id", "right_id")


def largest_remainder(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """K28. Proportional shares of total as integers; the largest remainders get the rest, ties by key. counts is one row a
    stratum, so its single-partition windows are small by definition."""
    everything = Window.partitionBy()
    quota = F.col(n) * total / F.sum(n).over(everything)
    c = counts.withColumn("quota", quota).withColumn("low", F.floor("quota"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("quota") - F.col("low"), 9)), key))
    return c.withColumn("_place", place).withColumn("_short", total - F.sum("low").over(everything)).select(key, (F.col("low") + (F.col("_place") <= F.col("_short")).cast("int")).cast("long").alias("share"))


def first_free_name(names: DataFrame, wanted: DataFrame, limit: int = 999) -> DataFrame:
    """V5. For wanted (folder, stem, ext) the first of stem.ext, stem(1).ext, ... stem(limit).ext that names (folder, name) lacks; null
    where all are taken."""
    tries = wanted.select("folder", "stem", "ext", F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("n"))
    name = F.when(F.col("n") == 0, F.concat("stem", "ext")).otherwise(F.concat("stem", F.lit("("), F.col("n").cast("string"), F.lit(")"), "ext"))
    taken = names.select("folder", "name").distinct().withColumn("_taken", F.lit(True))
    tried = tries.withColumn("name", name).join(taken, ["folder", "name"], "left")
    return tried.groupBy("folder", "stem", "ext").agg(F.min_by("name", F.when(F.col("_taken").isNull(), F.col("n"))).alias("name"))


def missing_parts(bitmap: Column) -> Column:
    """V7. Indices from 0 of the parts not yet received."""
    return F.filter(F.transform(bitmap, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())


#: A key that holds one of these is sensitive.
MARKERS = ("password", "secret", "token", "key", "authorization", "cookie", "credential")


def redacted(m: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """P26 for flat maps. Map values under a key that holds one of the markers are masked."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("|".join(markers)), "***").otherwise(v))


def offset_page(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """T4. A page from 1 in an order that ends in a unique key, with the total of all rows; limit is held to 1 ... 200."""
    limit, page = min(max(limit, 1), 200), max(page, 1)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit).crossJoin(F.broadcast(total))  # one row


def under_path(path: Column, prefix: str) -> Column:
    """P11. Whether a path is the prefix or below it."""
    return (path == prefix) | path.startswith(prefix + "/")


def moved(path: Column, old: str, new: str) -> Column:
    """P12. The path after its subtree moved from old to new; other paths stay."""
    return F.when(under_path(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def priced(usage: DataFrame, models: DataFrame) -> DataFrame:
    """B2. usage (model) with the price of its model: that of the display name, else of the provider's id, active models first
    and then the earliest, else 0. models: name, provider_id, is_active, created_at, prompt_price, completion_price."""
    prices = ["prompt_price", "completion_price"]
    by_name = models.select(F.col("name").alias("model"), *[F.col(c).alias(f"_n_{c}") for c in prices]).dropDuplicates(["model"])
    w = Window.partitionBy("provider_id").orderBy(F.desc("is_active"), "created_at", "name")
    by_id = models.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("provider_id").alias("model"), *[F.col(c).alias(f"_p_{c}") for c in prices])
    j = usage.join(by_name, "model", "left").join(by_id, "model", "left")
    return j.select(*usage.columns, *[F.coalesce(f"_n_{c}", f"_p_{c}", F.lit(0)).alias(c) for c in prices])


def ledger(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """B3. entries with a signed amount, in an order: whether each is applied and the balance after it. A debit larger than the
    balance is refused and changes nothing; so the fold runs over one key's entries, which a group of the job holds."""
    e = F.array_sort(F.collect_list(F.struct(*order, "amount")))
    kind = "array<struct<ok: boolean, balance: decimal(28,2)>>"

    def step(a, x):
        had = F.coalesce(F.try_element_at(a, F.lit(-1))["balance"], F.lit(0).cast("decimal(28,2)"))
        ok = had + x["amount"] >= 0
        return F.concat(a, F.array(F.struct(ok.alias("ok"), F.when(ok, had + x["amount"]).otherwise(had).cast("decimal(28,2)").alias("balance")))).cast(kind)

    g = entries.groupBy(*keys).agg(e.alias("e")).withColumn("r", F.aggregate("e", F.expr(f"cast(array() as {kind})"), step))
    z = g.select(*keys, F.explode(F.arrays_zip("e", "r")).alias("x"))
    return z.select(*keys, *[F.col(f"x.e.{c}").alias(c) for c in order], F.col("x.e.amount").alias("amount"), F.col("x.r.ok").alias("applied"), F.col("x.r.balance").alias("balance_after"))


def known_prices(usage: DataFrame, injected: DataFrame, builtin: DataFrame) -> DataFrame:
    """B6. usage (model, prompt_tokens, completion_tokens) with cost and source: prices given for a thousand tokens (injected: model,
    prompt, completion) go before built-in ones for a million; a model of neither has a null cost, never nought."""
    i = injected.select("model", F.struct("prompt", "completion").alias("_i")).dropDuplicates(["model"])
    b = builtin.select("model", F.struct("prompt", "completion").alias("_b")).dropDuplicates(["model"])
    j = usage.join(i, "model", "left").join(b, "model", "left")
    total = lambda p, per: (F.col("prompt_tokens") * F.col(f"{p}.prompt") + F.col("completion_tokens") * F.col(f"{p}.completion")) / per
    cost = F.when(F.col("_i").isNotNull(), total("_i", 1000)).when(F.col("_b").isNotNull(), total("_b", 1_000_000))
    source = F.when(F.col("_i").isNotNull(), "injected").when(F.col("_b").isNotNull(), "builtin").otherwise("unknown")
    return j.select(*usage.columns, F.round(cost, 6).alias("cost"), source.alias("source"))
