import pytest
from pyspark.sql import functions as F

from rowloom.model import ColumnSpec as C
from rowloom.model import ForeignKey, RepetitionRule, TableSpec
from rowloom.operators.generate import GenerateOptions, generate_table
from rowloom.operators.quality import integrity_report
from rowloom.operators import references
from rowloom.operators.references import MissingParents, apply_updates
from rowloom.operators.uniqueness import make_unique, with_suffix
from rowloom.functions.literals import DIALECTS
from rowloom.plans.seeding import ChainRule, SeedOptions, script_of, seed

UUID = {"uuid": True}
USERS = TableSpec(
    "users",
    (C("id", **UUID), C("manager_id", **UUID), C("username", "varchar", False, 50), C("email", "varchar", False, 100),
     C("created_at", "timestamp"), C("is_active", "boolean")),
    ("id",), (ForeignKey(("manager_id",), "users", ("id",), name="manager"),), (("username",), ("email",)),
)
PROFILES = TableSpec(
    "user_profiles", (C("id", **UUID), C("user_id", nullable=False, **UUID), C("country", "varchar", length=50)),
    ("id",), (ForeignKey(("user_id",), "users", ("id",), True),), (("user_id",),),
)
ROLES = TableSpec("roles", (C("id", **UUID), C("role_name", "varchar", False, 50)), ("id",), (), (("role_name",),))
USER_ROLES = TableSpec(
    "user_roles", (C("id", **UUID), C("user_id", nullable=False, **UUID), C("role_id", nullable=False, **UUID), C("assigned_by", **UUID)),
    ("id",),
    (ForeignKey(("user_id",), "users", ("id",)), ForeignKey(("role_id",), "roles", ("id",)),
     ForeignKey(("assigned_by",), "users", ("id",))),
    (("user_id", "role_id"),),
)
REVIEWS = TableSpec(
    "reviews", (C("id", "int"), C("user_id", **UUID), C("rating", "int", min_value=1, max_value=5), C("comment")),
    ("id",), (ForeignKey(("user_id",), "users", ("id",)),),
)
SHOP = (USERS, PROFILES, ROLES, USER_ROLES, REVIEWS)


def violations(tables, specs, rows=None):
    return integrity_report(tables, specs, rows).where("violations > 0").collect()


def test_web_shop(spark):
    rules = {"users": [RepetitionRule(4, {"is_active": "true"}, ("created_at",), {"username": "u[0-9]{4}"})]}
    made = seed(spark, SHOP, SeedOptions(rows=60, chains={"users": {"manager": ChainRule(3)}}, rules=rules))
    assert violations(made.tables, SHOP, {s.name: 60 for s in SHOP}) == []
    assert not made.deferred and set(made.updates) == {"users"}
    first = made.tables["users"].where("_rule_id = 0")
    # The rule pins a whole unique key, so it makes one row.
    assert [bool(r["is_active"]) for r in first.collect()] == [True]
    whole = apply_updates(made.inserts["users"], made.updates["users"], ["id"])
    assert whole.select("id", "manager_id").exceptAll(made.tables["users"].select("id", "manager_id")).isEmpty()
    levels = {r["node"]: r["level"] for r in made.levels.collect()}
    assert levels["users"] == 0 and levels["user_roles"] == 1


def two_tables(nullable):
    authors = TableSpec("authors", (C("id", "int"), C("name", "string", False), C("book_id", "int", nullable)), ("id",),
                        (ForeignKey(("book_id",), "books", ("id",)),))
    books = TableSpec("books", (C("id", "int"), C("title", "string", False), C("author_id", "int", nullable)), ("id",),
                      (ForeignKey(("author_id",), "authors", ("id",)),))
    return authors, books


def test_nullable_cycle_gives_updates(spark):
    specs = two_tables(True)
    made = seed(spark, specs, SeedOptions(rows=20))
    assert not made.deferred and set(made.updates) == {"authors", "books"}
    assert made.inserts["authors"].where("book_id is not null").isEmpty()
    applied = {n: apply_updates(made.inserts[n], made.updates[n], ["id"]) for n in made.inserts}
    assert violations(applied, specs) == [] and applied["authors"].where("book_id is null").isEmpty()


def test_required_cycle_is_deferred(spark):
    specs = two_tables(False)
    made = seed(spark, specs, SeedOptions(rows=20))
    assert made.deferred and made.updates == {}
    assert violations(made.tables, specs, {"authors": 20, "books": 20}) == []


def test_parent_trouble(spark):
    parent = TableSpec("p", (C("id", "int"),), ("id",))
    needy = TableSpec("c", (C("id", "int"), C("p_id", "int", False)), ("id",), (ForeignKey(("p_id",), "p", ("id",)),))
    with pytest.raises(MissingParents):
        seed(spark, (parent, needy), SeedOptions(rows={"p": 0, "c": 5}, deferred=False)).tables["c"].collect()
    single = TableSpec("c", (C("id", "int"), C("p_id", "int", False)), ("id",), (ForeignKey(("p_id",), "p", ("id",), True),))
    with pytest.raises(MissingParents):
        seed(spark, (parent, single), SeedOptions(rows={"p": 3, "c": 5}, deferred=False))
    loose = TableSpec("c", (C("id", "int"), C("p_id", "int")), ("id",), (ForeignKey(("p_id",), "p", ("id",), True),))
    rows = seed(spark, (parent, loose), SeedOptions(rows={"p": 3, "c": 5}, deferred=False)).tables["c"]
    assert rows.where("p_id is null").count() == 2
    unknown = seed(spark, (needy,), SeedOptions(rows=4, deferred=False)).tables["c"]
    assert unknown.where("p_id is null").count() == 4


def test_exclusions_and_uuid_override(spark):
    parent = TableSpec("p", (C("id", "int"), C("note", "string", False)), ("id",))
    child = TableSpec("c", (C("id", "int"), C("p_id", "int", False)), ("id",), (ForeignKey(("p_id",), "p", ("id",)),))
    made = seed(spark, (parent, child), SeedOptions(rows=9, deferred=False, uuid_keys={"p": {"id"}}, excluded_columns={"p": frozenset({"note"})}))
    assert dict(made.tables["c"].dtypes)["p_id"] == "string"
    assert violations({"p": made.tables["p"]}, (TableSpec("p", (C("id"),), ("id",)),)) == []
    joined = made.tables["c"].join(made.tables["p"].withColumnRenamed("id", "p_id"), "p_id")
    assert joined.count() == 9 and joined.where("note is not null").isEmpty()
    assert set(seed(spark, (parent, child), SeedOptions(rows=3, deferred=False, excluded_tables=frozenset({"p"}))).tables) == {"c"}


def test_pinned_key_is_not_generated_again(spark):
    spec = TableSpec("t", (C("id", "int"), C("v", "int", False)), ("id",))
    for pinned in range(1, 8):
        rules = (RepetitionRule(3, {"ID": str(pinned)}),)
        df = generate_table(spark, spec, 10, GenerateOptions(1, rules=rules))
        assert df.count() == 10 and df.select("id").distinct().count() == 10
        assert df.where("_rule_id = 0").select("id").collect() == [(pinned,)]


def test_rule_rows_raise_the_total(spark):
    spec = TableSpec("t", (C("id", "int"), C("v", "int", False), C("w", "int")), ("id",))
    rules = (RepetitionRule(6, {"v": "3"}), RepetitionRule(6, {"v": "4", "w": None}, ()))
    df = generate_table(spark, spec, 5, GenerateOptions(1, rules=rules))
    assert df.groupBy("_rule_id", "v").count().orderBy("v").collect() == [(0, 3, 6), (1, 4, 6)]
    assert df.where("_rule_id = 1 and w is not null").isEmpty()


def test_capacity_and_empty_table(spark):
    spec = TableSpec("t", (C("a", "int", min_value=1, max_value=4), C("b", "int", min_value=1, max_value=5)), ("a", "b"))
    df = generate_table(spark, spec, 100)
    assert df.count() == 20 and df.select("a", "b").distinct().count() == 20
    assert generate_table(spark, TableSpec("t", ()), 10).count() == 0


def test_text_key_in_a_short_column(spark):
    spec = TableSpec("t", (C("code", "char", False, 2), C("name", "varchar", False, 30)), ("code",), unique_keys=(("name",),))
    df = generate_table(spark, spec, 5000)
    assert df.count() == 36**2 and df.select("code").distinct().count() == 36**2
    assert df.select("name").distinct().count() == 36**2


def test_make_unique_leaves_out_what_cannot_fit(spark):
    rows = spark.range(40).withColumnRenamed("id", "_idx").withColumn("code", F.col("_idx") % 5)
    done = make_unique(rows, ["code"], lambda df, r: df.withColumn("code", (F.col("_idx") + r) % 7), rounds=3)
    assert done.rows.count() == 7 and done.rows.select("code").distinct().count() == 7 and done.left_out.count() == 33
    codes = spark.range(38).withColumnRenamed("id", "code")
    full = make_unique(rows, ["code"], lambda df, r: df, rounds=1, domain=codes)
    assert full.rows.select("code").distinct().count() == 38 and full.left_out.select("_idx").collect() == [(38,), (39,)]
    suffixed = rows.select(with_suffix(F.lit("abcdefgh"), F.col("_idx"), 8, 2).alias("s"))
    assert suffixed.distinct().count() == 40 and suffixed.where(F.length("s") > 8).isEmpty()


def test_xxhash_rows_keep_the_rules(spark):
    made = seed(spark, SHOP, SeedOptions(rows=30, deferred=True, table=GenerateOptions(5, "xxhash64")))
    assert violations(made.tables, SHOP, {s.name: 30 for s in SHOP}) == []


def test_script_of_a_schema(spark):
    made = seed(spark, SHOP, SeedOptions(rows=30, chains={"users": {"manager": ChainRule(3)}}))
    lines = script_of(spark, made, SHOP, DIALECTS["h2"], {"reviews": frozenset({"comment"})}).orderBy("section", "part", "line").collect()
    texts = [r["statement"] for r in lines]
    assert [t.split()[0] for t in texts] == ["INSERT"] * 5 + ["UPDATE"] * 30
    names = [t.split()[2] for t in texts[:5]]
    assert names.index('"users"') < names.index('"user_roles"') and names.index('"roles"') < names.index('"user_roles"')
    assert next(t for t in texts if '"reviews"' in t).count("DEFAULT") == 30
    assert all(t.startswith('UPDATE "users" SET "manager_id"=\'') for t in texts[5:])


def test_combinations_beyond_the_code_reach_every_parent(spark, monkeypatch):
    sizes = [10, 400]
    places = references.combination_positions(F.col("id"), [1 << 40, 1 << 41], 3)
    wide = spark.range(5000).select(*[p.alias(f"p{i}") for i, p in enumerate(places)])
    assert wide.distinct().count() == 5000
    assert wide.where(f"p0 < 0 or p0 >= {1 << 40} or p1 < 0 or p1 >= {1 << 41}").isEmpty()
    assert wide.where(f"p1 >= {1 << 40}").count() > 1000
    monkeypatch.setattr(references, "MAX_COMBINATIONS", 1100)
    places = references.combination_positions(F.col("id"), sizes, 3)
    rows = [tuple(r) for r in spark.range(1000).select(*places).collect()]
    assert len(set(rows)) == 1000 and all(0 <= a < 10 and 0 <= b < 400 for a, b in rows)
    assert max(b for _, b in rows) > 350
