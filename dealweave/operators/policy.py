"""Access policy over identities: overlay of policy documents, rule matching, decision cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave import lexicon as lx
from dealweave.functions import text as T

# which parts of an identity each list is tested against
TESTED = {
    "blocked_emails": ("email",), "blocked_domains": ("domain",), "blocked_users": ("username", "user_id"),
    "allowed_emails": ("email", "local"), "allowed_domains": ("domain",), "allowed_users": ("username", "user_id"),
    "admin_emails": ("email", "local"), "admin_domains": ("domain",), "admin_users": ("username", "user_id"),
}
SCOPES = ("global", "email", "username", "userid")  # later wins


def override_key(c: Column) -> Column:
    return F.url_encode(F.lower(T.strip(F.coalesce(c, F.lit("")))))


def identity_parts(identities: DataFrame) -> DataFrame:
    low = lambda c: F.lower(T.strip(F.coalesce(F.col(c), F.lit(""))))
    # a small file is one split; nine lists and their entries are made of each row
    i = identities.repartition("ident_id").select("ident_id", low("email").alias("email"), low("username").alias("username"), low("user_id").alias("user_id"))
    at = F.contains(F.col("email"), F.lit("@"))
    return i.withColumns({
        "domain": F.when(at, F.get(F.split("email", "@"), F.lit(1))).otherwise(""),
        "local": F.when(at, F.get(F.split("email", "@"), F.lit(0))).otherwise("")})


def entry_keys(value: Column) -> Column:
    """Every rule entry that would match ``value``, so that rule matching is an equi-join.

    The value itself; its suffixes from each ``@`` or ``.`` on, plain and with a leading star.
    The catch-all entries are handled apart."""
    marks = F.filter(F.transform(F.split(value, ""), lambda ch, i: F.when(ch.isin("@", "."), i + 1)), lambda p: p.isNotNull())
    tails = F.transform(marks, lambda p: F.substr(value, p))
    return F.array_distinct(F.concat(F.array(value), tails, F.transform(tails, lambda t: F.concat(F.lit("*"), t))))


def list_hits(parts: DataFrame, rules: DataFrame, own: bool = False) -> DataFrame:
    """(ident_id, list_name) pairs with a matching entry. ``rules`` is (list_name, entry), plus
    ident_id when ``own`` rules of each identity are meant."""
    on = ["ident_id"] if own else []
    rules = rules.select(*on, "list_name", F.lower(T.strip(F.col("entry"))).alias("entry")).where("entry <> ''").distinct()
    pieces = F.array(*[F.struct(F.lit(n).alias("list_name"), F.col(p).alias("value")) for n, ps in TESTED.items() for p in ps])
    # the parts of one identity differ within its row; rows of it that repeat leave with the last distinct
    asked = parts.select("ident_id", F.explode(F.array_distinct(pieces)).alias("p")).select("ident_id", "p.*").where("value <> ''")
    keyed = asked.select("ident_id", "list_name", F.explode(entry_keys(F.col("value"))).alias("entry"))
    named = keyed.join(rules.where("entry NOT IN ('*', 'all')"), [*on, "list_name", "entry"]).select("ident_id", "list_name")
    every = rules.where("entry IN ('*', 'all')").select(*on, "list_name").distinct()
    # Global catch-alls are at most one row per list; a broadcast of nine names.
    everyone = asked.select("ident_id", "list_name").join(every if own else F.broadcast(every), [*on, "list_name"]).select("ident_id", "list_name")
    return named.unionAll(everyone).distinct()


def effective_policy(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(ident_id, field, value): per field the value of the most specific document.

    ``docs`` is (scope, scope_key, field, value). Global fields are not copied per identity;
    see :func:`with_global`."""
    ids = parts.select("ident_id", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scope"), override_key(F.col(c)).alias("scope_key"), F.lit(n).alias("rank"), F.col(c).alias("v"))
        for n, (s, c) in enumerate((("email", "email"), ("username", "username"), ("userid", "user_id")), 1)])).alias("k")).select("ident_id", "k.*").where("v <> ''").drop("v")
    own = ids.join(docs, ["scope", "scope_key"])
    return own.groupBy("ident_id", "field").agg(F.max_by("value", "rank").alias("value"))


def with_global(parts: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """Full effective policy: global fields for everyone, replaced by the identity's own."""
    shared = docs.where("scope = 'global'").groupBy("field").agg(F.max("value").alias("value")).withColumn("_one", F.lit(1))
    # One document's fields: a handful of rows whatever the number of identities.
    base = parts.select("ident_id", F.lit(1).alias("_one")).join(shared, "_one").select("ident_id", "field", F.col("value").alias("g"))
    return base.join(own, ["ident_id", "field"], "full_outer").select("ident_id", "field", F.coalesce("value", "g").alias("value"))


def _field(names, filled: bool = False) -> Column:
    """First present (or first filled) alias of a scalar field, from long (field, value) rows."""
    test = lambda n: (F.col("field") == n) & ((F.col("value") != "") if filled else F.lit(True))
    return F.coalesce(*[F.max(F.when(test(n), F.col("value"))) for n in names])


def scalar_fields(fields: DataFrame, keys=("ident_id",)) -> DataFrame:
    return fields.groupBy(*keys).agg(
        _field(("status",)).alias("status"), _field(lx.BLOCK_ALL_KEYS).alias("block_all"), _field(lx.BLOCK_KEYS).alias("blocked"),
        _field(lx.ALLOW_KEYS).alias("allowed_flag"), _field(lx.ADMIN_KEYS).alias("admin_flag"), _field(("role",)).alias("role"),
        _field(("message", "reason", "denied_message"), filled=True).alias("message"), _field(("allowed_message",)).alias("allowed_message"))


def list_fields(fields: DataFrame, keys=()) -> DataFrame:
    """(keys, list_name, entry): entries of the first non-empty alias of each list.

    Fields are merged before aliases are: pass the effective fields of an identity, not one document's."""
    alias = F.create_map(*[F.lit(x) for n, ks in lx.POLICY_LIST_KEYS.items() for a, k in enumerate(ks) for x in (k, f"{n}:{a}")])
    f = fields.withColumn("_a", F.try_element_at(alias, F.col("field"))).where("_a IS NOT NULL").withColumn("entries", T.policy_entries(F.col("value"))).where(F.size("entries") > 0)
    f = f.withColumns({"list_name": F.split_part("_a", F.lit(":"), F.lit(1)), "_n": F.split_part("_a", F.lit(":"), F.lit(2)).cast("int")})
    return f.groupBy(*keys, "list_name").agg(F.min_by("entries", "_n").alias("e")).select(*keys, "list_name", F.explode("e").alias("entry"))


def list_aliases() -> list[str]:
    return [k for ks in lx.POLICY_LIST_KEYS.values() for k in ks]


def decide(parts: DataFrame, hits: DataFrame, present: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """Decision cascade. ``hits`` and ``present`` are (ident_id, list_name): lists that match and
    lists that have any entry for the identity."""
    def flags(df, prefix):
        return df.groupBy("ident_id").agg(*[F.max(F.when(F.col("list_name") == n, True).otherwise(False)).alias(f"{prefix}{n}") for n in TESTED])

    j = parts.join(flags(hits, "h_"), "ident_id", "left").join(flags(present, "p_"), "ident_id", "left")
    if scalars is not None:
        j = j.join(scalars, "ident_id", "left")
    on = lambda name: F.coalesce(F.col(name), F.lit(False))
    some = lambda prefix, kind: reduce(lambda a, b: a | b, [on(f"{prefix}{kind}_{x}") for x in ("emails", "domains", "users")])
    raw = lambda name: F.col(name) if scalars is not None else F.lit(None).cast("string")
    flag = lambda name, default: T.as_flag(raw(name), lx.POLICY_TRUE, lx.POLICY_FALSE, default)
    hard = (
        F.coalesce(F.lower(T.strip(raw("status"))).isin(*lx.BLOCKING_STATUS), F.lit(False)) | flag("block_all", False)
        | flag("blocked", False) | (raw("allowed_flag").isNotNull() & ~flag("allowed_flag", True)))
    admin = F.when(some("p_", "admin"), some("h_", "admin")).otherwise(
        flag("admin_flag", False) | F.coalesce(F.lower(T.strip(raw("role"))).isin("admin", "owner"), F.lit(False)))
    denied = some("h_", "blocked") | (some("p_", "allowed") & ~some("h_", "allowed"))
    reason = (
        F.when(hard, "policy").when(on("h_blocked_emails"), "blocked email").when(on("h_blocked_domains"), "blocked domain")
        .when(on("h_blocked_users"), "blocked user").when(denied, "not on an allow list").otherwise("allowed"))
    allowed = ~hard & ~denied
    text = F.when(allowed, F.coalesce(T.null_if_blank(T.strip(raw("allowed_message"))), F.lit(lx.GRANTED_MESSAGE))).otherwise(
        F.coalesce(T.null_if_blank(T.strip(raw("message"))), F.lit(lx.DENIED_MESSAGE)))
    return j.select("ident_id", allowed.alias("allowed"), (~hard & admin).alias("is_admin"), reason.alias("reason"), text.alias("message"))


def access_decisions(identities: DataFrame, docs: DataFrame) -> DataFrame:
    """Whole evaluation from policy documents. An identity's own field replaces the global field of the same
    name, an empty value clears it; only then does each list take its first non-empty alias.

    Lists that no own field touches are the same for everyone and are matched against the global entries; where an own
    field is an alias of the list, the identity has the list of its merged fields."""
    parts = identity_parts(identities)
    own = effective_policy(parts, docs)
    shared = docs.where("scope = 'global'").groupBy("field").agg(F.max("value").alias("value"))
    alias = F.create_map(*[F.lit(x) for n, ks in lx.POLICY_LIST_KEYS.items() for k in ks for x in (k, n)])
    touched = own.withColumn("list_name", F.try_element_at(alias, F.col("field"))).where("list_name IS NOT NULL").select("ident_id", "list_name").distinct()
    of_list = shared.withColumn("list_name", F.try_element_at(alias, F.col("field"))).where("list_name IS NOT NULL")
    kept = touched.join(of_list, "list_name").select("ident_id", "field", F.col("value").alias("g"))
    merged = kept.join(own.where(F.col("field").isin(*list_aliases())), ["ident_id", "field"], "full_outer").select("ident_id", "field", F.coalesce("value", "g").alias("value"))
    own_lists, shared_lists = list_fields(merged, ["ident_id"]), list_fields(shared)
    hits = list_hits(parts, own_lists, own=True).unionAll(list_hits(parts, shared_lists).join(touched, ["ident_id", "list_name"], "left_anti"))
    names = F.broadcast(shared_lists.select("list_name").distinct().withColumn("_one", F.lit(1)))  # at most nine
    everyone = parts.select("ident_id", F.lit(1).alias("_one")).join(names, "_one").select("ident_id", "list_name").join(touched, ["ident_id", "list_name"], "left_anti")
    present = own_lists.select("ident_id", "list_name").distinct().unionAll(everyone).distinct()
    plain = docs.where(~F.col("field").isin(*list_aliases()))
    return decide(parts, hits, present, scalar_fields(with_global(parts, own.where(~F.col("field").isin(*list_aliases())), plain)))
