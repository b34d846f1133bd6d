"""From documents to a plan in one call, for one collection or many."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.infer import Profile
from ..plans.nesting import Plan, build_plan, describe_shape
from ..shared import materialize
from .profile import MAX_PATHS, first_rows, maps, outside, profile_facts, profile_paths, profile_typed, with_fill
from .walk import facts


def profile_documents(docs: DataFrame, max_paths: int = MAX_PATHS) -> tuple[DataFrame, int]:
    """Profile rows with fill, and the number of documents."""
    docs = docs.persist()
    documents = docs.count()
    # Written, as its rows meet those of their containers and the documents would be walked for both.
    return with_fill(materialize(profile_facts(facts(docs), max_paths=max_paths)), documents), documents


def document_maps(docs: DataFrame, min_keys: int = 30, max_fill: float = 0.2) -> DataFrame:
    """Objects whose keys are data (see ``maps``), found among all paths, however many."""
    docs = docs.persist()
    documents = docs.count()
    return maps(with_fill(materialize(profile_paths(facts(docs))), documents), min_keys, max_fill)


def plan_documents(
    docs: DataFrame, collection: str, nesting: str = "deep", schema: str = "dbo", min_keys: int = 30, max_fill: float = 0.2, headroom: float = 1.5
) -> tuple[Plan, Profile]:
    plans, errors = _plan_all(docs.select(F.lit(collection).alias("collection"), "seq", "v"), [collection], nesting, schema, min_keys, max_fill, headroom, nulls=True)
    return plans[collection]


BY = ("collection",)


def _plan_all(docs, names, nesting="deep", schema="dbo", min_keys=30, max_fill=0.2, headroom=1.5, nulls=False):
    """Plans and profiles of documents (collection, seq, v), profiled together. Data keys don't count against the limit of
    paths: objects that have them are found among all paths, and where a collection has more than the limit, what lies
    inside those objects is left out first. nulls: a null v is a document without fields, not an error."""
    docs = docs.persist()
    counts = docs.groupBy(*BY).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("broken"))
    known = {r["collection"]: r for r in counts.collect()}
    counts = docs.sparkSession.createDataFrame([(c, r["n"]) for c, r in known.items()], "collection string, n long")
    errors = {} if nulls else {c: f"{r['broken']} documents are not JSON" for c, r in known.items() if r["broken"]}
    # Written, as it is read several times, and plans that hold others in memory are repeated in each other's texts, which
    # the driver keeps.
    paths = with_fill(materialize(profile_paths(facts(docs, by=BY), by=BY)), counts, BY)
    docs.unpersist()
    boxes = found = maps(paths, min_keys, max_fill, BY).persist()
    many = paths.groupBy(*BY).count().where(F.col("count") > MAX_PATHS).select("collection")
    kept = paths
    if not many.isEmpty():
        large, small = boxes.join(many, "collection", "left_semi"), boxes.join(many, "collection", "left_anti")
        large = outside(large, large, BY)
        boxes, kept = large.unionByName(small), outside(paths, large, BY)
    # One path more than the limit tells whether any was left out.
    rows = first_rows(kept, MAX_PATHS + 1, BY).persist()
    cut = {r["collection"] for r in rows.where(F.col("first") > MAX_PATHS).select("collection").collect()}
    by_name: dict[str, list] = {}
    for r in rows.where(F.col("first") <= MAX_PATHS).collect():
        by_name.setdefault(r["collection"], []).append(r)
    infos: dict[str, dict] = {}
    for r in boxes.collect():
        infos.setdefault(r["collection"], {})[r["path"]] = r.asDict()
    plans = {}
    for name in names:
        if name in errors or (name not in known and not nulls):
            continue
        profile = Profile.of_rows(by_name.get(name, []), known[name]["n"] if name in known else 0, name in cut)
        own = {p: i for p, i in infos.get(name, {}).items() if p in profile.stats}
        plans[name] = (build_plan(profile, name, schema, own, nesting, headroom), profile)
    for held in (rows, found):
        held.unpersist()
    return plans, errors


def plan_typed(df: DataFrame, collection: str, nesting: str = "deep", schema: str = "dbo", headroom: float = 1.5, key: str = "_id") -> tuple[Plan, Profile]:
    """Plan of typed rows, from aggregations generated from their schema."""
    df = df.persist()
    documents = df.count()
    rows = profile_typed(df, key).persist()
    profile = Profile.collect(with_fill(rows, documents), documents)
    for held in (rows, df):
        held.unpersist()
    return build_plan(profile, collection, schema, None, nesting, headroom), profile


def plan_many(collections: dict[str, DataFrame], **options) -> tuple[dict[str, Plan], dict[str, str]]:
    """Plans by collection, and errors by collection, from one pass over all of them. Empty collections are left out.
    Documents whose v is null are broken: their collection is an error and the rest goes on. A collection that cannot
    be read at all makes the pass fail; then each is planned by itself."""
    errors, docs = {}, None
    for name, own in collections.items():
        try:
            named = own.select(F.lit(name).alias("collection"), "seq", "v")
            docs = named if docs is None else docs.unionAll(named)
        except AnalysisException as e:
            errors[name] = str(e)
    if docs is None:
        return {}, errors
    names = [n for n in collections if n not in errors]
    try:
        plans, broken = _plan_all(docs, names, **options)
        return {n: p for n, (p, _) in plans.items()}, errors | broken
    except Exception as e:  # noqa: BLE001
        if len(names) == 1:
            return {}, errors | {names[0]: str(e)}
    plans = {}
    for name in names:
        own, failed = plan_many({name: collections[name]}, **options)
        plans |= own
        errors |= failed
    return plans, errors


def peek_shape(docs: DataFrame, size: int = 5000) -> dict:
    """Shape of a bounded sample."""
    filled, documents = profile_documents(docs.orderBy(F.xxhash64("seq")).limit(size))
    return describe_shape(Profile.collect(filled, documents))
