import pytest

from tesselar.functions.partition import shard_of
from tesselar.plans.catalog import Catalog, RoutingError, ShardedTable
from tesselar.plans.planner import QueryCache, Source, dry_run, is_read, prune, prune_relation, relations, route, route_statement
from tesselar.plans.plugins import Registry, RouteHint, Shard, primary_only

T = ShardedTable("t", "id", 4)
C = Catalog(4, [T], {"o"}, schemas={"east": 1, "any": None}, comment_prefix="x")


def s(*keys):
    return frozenset(shard_of(k, "bigint", 4) for k in keys)


@pytest.mark.parametrize(
    "predicate, keys",
    [("id = 1", (1,)), ("1 = id", (1,)), ("id <=> 5", (5,)), ("id IN (1, 2, 3)", (1, 2, 3)), ("id = '7'", (7,)), ("t.id = -1", (-1,)), ("id = 1 OR id = 9", (1, 9)), ("id = 1 AND v > 3", (1,)), ("id = :k", (11,)), ("id = 1.0", (1,)), ("id = CAST('7' AS INT)", (7,)), ("id = 3 + 4", (7,)), ("id = -(5)", (-5,)), ("ID = 1", (1,)), ("T.id = 1", (1,)), ("id IN (1, 2.5, 99999999999999999999)", (1,))],
)
def test_prunes(spark, predicate, keys):
    assert prune(spark, T, predicate, {"k": 11}) == s(*keys)


@pytest.mark.parametrize("predicate", ["other.id = 5", "id = 'abc'", "id = CAST('x' AS INT)", "id = 1e300 * 10", "id = 9007199254740993.0D", "v = 1", "id > 3", "id = 1 OR v = 2", "id <> 1", "NOT id = 1", "id = v", "id <=> NULL"])
def test_does_not_prune(spark, predicate):
    assert prune(spark, T, predicate) is None


def test_values_that_no_key_equals(spark):
    assert prune(spark, T, "id = 1.5") == prune(spark, T, "id = 99999999999999999999") == frozenset()


def test_other_names(spark):
    assert prune(spark, T, "a.id = 5", names=["a"]) == s(5) and prune(spark, T, "t.id = 5", names=["a"]) is None
    text = ShardedTable("t", "id", 4, kind="varchar")
    assert prune(spark, text, "id = 5") is None and prune(spark, text, "id = '5'") == frozenset({shard_of("5", "varchar", 4)})


def pruned_by(spark, sql):
    return {r.alias: prune_relation(T, r) for r in relations(spark, sql) if r.name == "t"}


def test_relations_of_statements(spark):
    assert pruned_by(spark, "SELECT * FROM t WHERE id = 1") == {"t": s(1)}
    assert pruned_by(spark, "SELECT * FROM t a, u b WHERE a.id = 1 AND b.id = 2") == {"a": s(1)}
    assert pruned_by(spark, "SELECT * FROM t a JOIN t b ON a.id = 3 WHERE b.id = 4") == {"a": s(3), "b": s(4)}
    assert pruned_by(spark, "SELECT * FROM t a LEFT JOIN t b ON a.id = 3 AND b.id = 4") == {"a": None, "b": s(4)}
    assert pruned_by(spark, "SELECT * FROM t a WHERE a.v IN (SELECT v FROM t b WHERE b.id = 5)") == {"a": None, "b": s(5)}
    assert pruned_by(spark, "WITH c AS (SELECT * FROM t x WHERE x.id = 6) SELECT * FROM c WHERE id = 7") == {"x": s(6)}
    assert pruned_by(spark, "WITH t AS (SELECT 1 AS id) SELECT * FROM t WHERE id = 7") == {}
    assert pruned_by(spark, "SELECT * FROM (SELECT id + 1 AS id FROM t) d WHERE d.id = 7") == {"t": None}
    assert pruned_by(spark, "SELECT id, count(*) FROM t GROUP BY id HAVING id = 7") == {"t": None}
    assert pruned_by(spark, "SELECT * FROM t x WHERE id = 1 UNION ALL SELECT * FROM t y WHERE id = 2") == {"x": s(1), "y": s(2)}


def test_route_statement(spark):
    assert route_statement(spark, C, "SELECT * FROM t a JOIN o ON a.v = o.v WHERE a.id = 1").shards == s(1)
    assert route_statement(spark, C, "SELECT * FROM t a, t b WHERE a.id = 1 AND b.id = 2").shards == s(1, 2)
    assert route_statement(spark, C, "SELECT * FROM o").shards == frozenset({0})
    assert route_statement(spark, C, "SELECT * FROM east.x").shards == frozenset({1})
    tenant = Catalog(4, [T], tenant_column="org")
    for bad in ("id = 1", "v = 'org'", "org IS NOT NULL", "org = 1 OR v = 2", "org > 3", "x.org = 1"):
        with pytest.raises(RoutingError):
            route(spark, tenant, "t", bad)
    assert route(spark, tenant, "t", "org = 1 AND v = 2") and route(spark, tenant, "t", "t.org IN (1, 2)")


def test_comment_prefix(spark):
    assert route(spark, C, "t", "id = 1", sql="/* max_shard: 3 */ SELECT 1").source == Source.SHARDED
    assert route(spark, C, "t", "id = 1", sql="/* my_x_shard: 3 */ SELECT 1").source == Source.SHARDED
    with pytest.raises(RoutingError):
        route(spark, C, "t", sql="/* x_shard: 9 */ SELECT 1")


def test_plugins(spark):
    seen = []
    registry = Registry()
    registry.register("log", lambda c: seen.append((c.tables, c.parameter_types())))
    registry.register("primary", primary_only(["t"]), init=seen.append, config={"a": 1}, fini=lambda: seen.append("end"))
    r = route(spark, C, "t", "id = :k", args={"k": 1}, plugins=registry.plugins)
    assert not r.read and r.shards == s(1) and seen == [{"a": 1}, (("t",), {"k": "int"})]
    assert route(spark, C, "t", "id = 1", plugins=(lambda c: RouteHint(Shard.DIRECT, [2]),)).shards == frozenset({2})
    assert route(spark, C, "t", "id = 1", plugins=(lambda c: RouteHint(Shard.ALL),)).shards is None
    with pytest.raises(RoutingError):
        route(spark, C, "t", plugins=(lambda c: RouteHint(Shard.BLOCKED),))
    with pytest.raises(ValueError):
        registry.register("new", lambda c: None, version=(2, 0))
    registry.close()
    assert seen[-1] == "end" and not registry.plugins


def test_conjunctions_intersect(spark):
    assert prune(spark, T, "id IN (1, 2, 3, 4) AND id = 3") == s(3)
    assert prune(spark, T, "id = NULL") == frozenset()


def test_sources(spark):
    r = route(spark, C, "t", "id = 1", sql="/* x_shard: 3 */ SELECT 1")
    assert (r.shards, r.source) == (frozenset({3}), Source.COMMENT)
    r = route(spark, C, "t", "id = 1", settings={"search_path": "east"})
    assert (r.shards, r.source) == (frozenset({1}), Source.SEARCH_PATH)
    r = route(spark, C, "t", "id = 1", sql="-- x_shard: 3\nSELECT 1", plugins=(lambda ctx: (frozenset({0}), False),))
    assert (r.shards, r.source, r.read) == (frozenset({0}), Source.PLUGIN, False)
    assert route(spark, C, "t").shards is None


def test_guards(spark):
    with pytest.raises(RoutingError):
        route(spark, Catalog(4, [T], cross_shard=False), "t", "v = 1")
    with pytest.raises(RoutingError):
        route(spark, Catalog(4, [T], tenant_column="org"), "t", "id = 1")
    with pytest.raises(RoutingError):
        route(spark, C, "o", sql="/* x_shard: 1 */ UPDATE o SET a = 1")
    with pytest.raises(RoutingError):
        route(spark, C, "t", plugins=(lambda ctx: ("blocked", None),))


def test_read_or_write():
    assert is_read("SELECT 'insert into x' FROM t") and is_read("WITH a AS (SELECT 1) SELECT * FROM a")
    for sql in ("INSERT INTO t VALUES (1)", "SELECT * FROM t FOR UPDATE", "SELECT nextval('s')", "WITH a AS (DELETE FROM t) SELECT 1"):
        assert not is_read(sql)


def test_cache(spark):
    c = QueryCache()
    for k in (1, 2):
        c.record(f"SELECT * FROM t WHERE id = {k}", route(spark, C, "t", f"id = {k}"))
    assert [tuple(r) for r in c.frame(spark).collect()] == [("SELECT * FROM t WHERE id = ?", 2, 2, 0)]


def test_dry_run(spark):
    c = QueryCache()
    assert dry_run(spark, C, "SELECT * FROM t WHERE id = 1", c).shards == s(1)
    assert c.seen == {"SELECT * FROM t WHERE id = ?": [1, 1, 0]}
