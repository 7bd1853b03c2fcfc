import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.engine import Engine, Options
from braidlake.errors import RequestError
from braidlake.functions.types import literal, wire
from braidlake.gql.parser import parse
from braidlake.gql.validate import Limits, aliases, complexity, depth
from braidlake.operators.metadata import channel, service
from braidlake.operators.search import ranked
from braidlake.plans.connection import Connection, Page
from braidlake.sources import samples
from braidlake.sources.catalog import Catalog, Declared, ForeignKey, is_junction
from braidlake.streaming import changes as feeds


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(samples.catalog(spark, sf), Options(timeout_s=None, query_limit=100))


@pytest.fixture(scope="module")
def small(spark):
    """Authors, books with versions and nulls, tags by a junction, one profile each."""
    authors = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, None)], "id long, name string")
    books = spark.createDataFrame(
        [(1, "a v1", 1, 0, 500), (1, "a v2", 1, 500, None), (2, "b", 1, 0, None), (3, "c", 2, 100, None), (4, "d", None, 0, None)],
        "id long, title string, author_id long, since long, until long")
    tags = spark.createDataFrame([(1, "x"), (2, "y")], "id long, label string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1)], "book_id long, tag_id long")
    profiles = spark.createDataFrame([(10, 1, [1, 5]), (11, 2, []), (12, 3, None)], "id long, author_id long, marks array<int>")
    declared = {
        "authors": Declared(key=("id",)),
        "books": Declared(key=("id",), foreign_keys=(ForeignKey("author_id", "authors", "id"),), versions=("since", "until")),
        "tags": Declared(key=("id",)),
        "book_tags": Declared(foreign_keys=(ForeignKey("book_id", "books", "id"), ForeignKey("tag_id", "tags", "id"))),
        "profiles": Declared(key=("id",), foreign_keys=(ForeignKey("author_id", "authors", "id", backward_single_name="profile"),), unique=(("author_id",),)),
    }
    frames = {"authors": authors, "books": books, "tags": tags, "book_tags": links, "profiles": profiles}
    meta = {"_metadata": lambda: spark.createDataFrame([("chain", '"main"'), ("lastProcessedHeight", "7")], "key string, value string")}
    return Engine(Catalog(spark, {n: (lambda n=n: frames[n]) for n in frames}, declared, meta), Options(timeout_s=None))


def data(engine, query, **variables):
    out = engine.graphql(query, variables)
    assert "errors" not in out, out
    return out["data"]


def test_nested_levels(small):
    got = data(small, "{ authors { totalCount nodes { name profile { marks } booksByAuthorId(orderBy: TITLE_DESC, first: 1) { totalCount pageInfo { hasNextPage } nodes { title author { name } tags { nodes { label } } } } } } }")
    ann, bob, none = got["authors"]["nodes"]
    assert got["authors"]["totalCount"] == 3
    assert ann["profile"] == {"marks": [1, 5]} and ann["booksByAuthorId"]["totalCount"] == 2 and ann["booksByAuthorId"]["pageInfo"] == {"hasNextPage": True}
    assert ann["booksByAuthorId"]["nodes"] == [{"title": "b", "author": {"name": "Ann"}, "tags": {"nodes": [{"label": "x"}]}}]
    assert none["booksByAuthorId"] == {"totalCount": 0, "pageInfo": {"hasNextPage": False}, "nodes": []} and bob["name"] == "Bob"


def test_history_is_inherited(small):
    query = '{ authors(filter: {name: {equalTo: "Ann"}}, %s) { nodes { booksByAuthorId { nodes { title } } } } }'
    titles = lambda arg: {b["title"] for b in data(small, query % arg)["authors"]["nodes"][0]["booksByAuthorId"]["nodes"]}
    assert titles('blockHeight: "50"') == {"a v1", "b"}
    assert titles("first: 5") == titles('blockHeight: "?"') == {"a v2", "b"}
    assert data(small, '{ book(id: "1", blockHeight: "3") { title } }')["book"] == {"title": "a v1"}


def test_relation_filters_and_lists(small):
    ids = lambda f: [int(n["id"]) for n in data(small, f"{{ authors(filter: {f}) {{ nodes {{ id }} }} }}")["authors"]["nodes"]]
    assert ids('{booksByAuthorId: {some: {title: {startsWith: "a"}}}}') == [1]
    assert ids('{booksByAuthorId: {none: {title: {startsWith: "a"}}}}') == [2, 3]
    assert ids('{booksByAuthorId: {every: {title: {lessThan: "b"}}}}') == [3]
    assert ids("{booksByAuthorId: {some: {id: {in: []}}}}") == [] and ids("{booksByAuthorId: {none: {id: {in: []}}}}") == [1, 2, 3]
    assert ids('{booksByAuthorId: {some: {tags: {some: {label: {equalTo: "y"}}}}}}') == [1]
    assert ids("{profile: {marks: {some: {greaterThan: 4}}}}") == [1] and ids("{profile: {marks: {isEmpty: true}}}") == [2]
    assert ids("{and: [], or: [], not: {}, name: {isNull: true, equalTo: null}}") == [3]
    books = lambda f: [int(n["id"]) for n in data(small, f"{{ books(filter: {f}) {{ nodes {{ id }} }} }}")["books"]["nodes"]]
    assert books("{authorExists: false}") == [4] and books('{author: {booksByAuthorId: {some: {title: {equalTo: "b"}}}}}') == [1, 2]


def test_metadata_health_and_errors(small):
    assert data(small, "{ _metadata { chain lastProcessedHeight targetHeight rowCountEstimate { table estimate } } }")["_metadata"]["lastProcessedHeight"] == 7
    assert data(small, "{ _metadatas { totalCount nodes { chain } } }")["_metadatas"] == {"totalCount": 1, "nodes": [{"chain": "main"}]}
    assert small.health()["status"] == "healthy"
    for bad in ("{ authors { nodes { nope } } }", "{ nope { id } }", "{ authors(first: 1, last: 1) { nodes { id } } }", '{ authors(after: "?") { nodes { id } } }', "{ authors(filter: {id: {like: 3}}) { nodes { id } } }", "{ authors(filter: {id: {equalTo: \"x\"}}) { nodes { id } } }", "{", '{ node(nodeId: "WyJ4Iiwx" ) { nodeId } }'):
        assert small.graphql(bad)["errors"], bad


def test_documents_and_variables(small):
    query = """query Q($n: Int = 1, $all: Boolean!) { a: authors(first: $n) { ...F @include(if: $all) nodes { __typename id @skip(if: $all) } } }
               fragment F on AuthorsConnection { totalCount }"""
    assert data(small, query, all=True) == {"a": {"totalCount": 3, "nodes": [{"__typename": "Author"}]}}
    assert data(small, query, all=False, n=2)["a"]["nodes"] == [{"__typename": "Author", "id": "1"}, {"__typename": "Author", "id": "2"}]
    assert small.graphql(query, {})["errors"]
    assert len(small.batch([{"query": "{ nodeId }"}] * 2)) == 2
    node = data(small, "{ authors(first: 1) { nodes { nodeId } } }")["authors"]["nodes"][0]["nodeId"]
    assert data(small, f'{{ node(nodeId: "{node}") {{ ... on Author {{ name }} }} authorByNodeId(nodeId: "{node}") {{ id }} }}') == {"node": {"name": "Ann"}, "authorByNodeId": {"id": "1"}}


def test_limits():
    doc = parse("query { a { b { ...F } x: c } } fragment F on T { d e { f } }")
    s = doc.operations[0].selection
    assert (depth(doc, s), complexity(doc, s), aliases(doc, s)) == (4, 6, 1)
    loop = parse("{ ...F } fragment F on T { ...F }")
    with pytest.raises(RequestError):
        depth(loop, loop.operations[0].selection)


def test_limits_of_engine(small):
    tight = Engine(small.catalog, Options(timeout_s=None, limits=Limits(depth=2, complexity=5, aliases=0, batch=1)))
    assert "depth" in tight.graphql("{ authors { nodes { id } } }")["errors"][0]["message"]
    small_cost = Engine(small.catalog, Options(timeout_s=None, limits=Limits(complexity=5)))
    many = "authors { totalCount pageInfo { hasNextPage hasPreviousPage startCursor endCursor } }"
    assert "complexity" in small_cost.graphql(f"{{ {many} }}")["errors"][0]["message"]
    assert "errors" not in small_cost.graphql(f"query IntrospectionQuery {{ {many} }}")
    assert small_cost.metrics["le_10"] == small_cost.metrics["requests"] == 2 and small_cost.metrics["errors"] == 1
    few = Engine(small.catalog, Options(timeout_s=None, group_limit=2))
    assert "groups" in few.graphql("{ authors { groupedAggregates(groupBy: [NAME]) { keys } } }")["errors"][0]["message"]
    assert tight.graphql("{ x: nodeId }")["errors"]
    with pytest.raises(RequestError):
        tight.batch([{}, {}])
    assert "errors" not in Engine(small.catalog, Options(timeout_s=None, unsafe=True, limits=Limits(depth=1))).graphql("{ authors { nodes { id } } }")


def test_schema(engine, small):
    text = small.sdl()
    for part in ("type Author {", "input AuthorFilter {", "input AuthorToManyBookFilter {", "enum BooksOrderBy {", "BOOKS_BY_AUTHOR_ID_COUNT_ASC", "AUTHORS_BY_AUTHOR_ID__NAME_ASC".replace("AUTHORS", "AUTHOR"), "enum books_distinct_enum {", "profile: Profile", "type BookSumAggregates {"):
        assert part in text, part
    got = data(engine, '{ __schema { queryType { name } types { name } } __type(name: "Order") { kind fields { name type { kind ofType { name } } } } }')
    assert got["__schema"]["queryType"]["name"] == "Query" and "OrdersConnection" in {t["name"] for t in got["__schema"]["types"]}
    assert is_junction(small.catalog.entity("book_tags")) and not is_junction(small.catalog.entity("books"))


def test_aggregates_wire(small):
    got = data(small, "{ authors { aggregates { count sum { id } min { id } distinctCount { name } stddevSample { id } } groupedAggregates(groupBy: [NAME]) { keys count } } }")["authors"]
    assert got["aggregates"] == {"count": "3", "sum": {"id": "6"}, "min": {"id": "1"}, "distinctCount": {"name": "2"}, "stddevSample": {"id": "1.0"}}
    assert got["groupedAggregates"] == [{"keys": ["Ann"], "count": "1"}, {"keys": ["Bob"], "count": "1"}, {"keys": [""], "count": "1"}]
    assert data(small, "{ authors { groupedAggregates(groupBy: []) { keys count } } }")["authors"]["groupedAggregates"] == [{"keys": [], "count": "3"}]


@pytest.mark.parametrize("order", [["O_ORDERPRIORITY_DESC", "O_TOTALPRICE_ASC"], ["O_ORDERPRIORITY_ASC"], None])
@pytest.mark.parametrize("nulls", [None, "NULLS_FIRST", "NULLS_LAST"])
def test_page_walk_is_the_scan(spark, sf, order, nulls):
    e = Engine(Catalog(spark, {"orders": lambda: spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))}, {"orders": Declared(key=("o_orderkey",))}), Options(query_limit=600))
    everything = [r["o_orderkey"] for r in Connection(e.scope("orders"), order=order, nulls=nulls, limit=None).rows()[0].collect()]
    for side, cursor, edge in (("first", "after", -1), ("last", "before", 0)):
        seen, args = [], {side: 400}
        while True:
            got = e.connection("orders", order=order, nulls=nulls, select=["o_orderkey"], **args).fetch()
            keys = [r["o_orderkey"] for r in got.rows]
            seen = seen + keys if side == "first" else keys + seen
            if not (got.has_next if side == "first" else got.has_previous):
                break
            args = {side: 400, cursor: got.cursor(got.rows[edge])}
        assert seen == everything


def test_random_filters(spark, engine, duck):
    g, columns = random.Random(5), {"oTotalprice": ("o_totalprice", lambda: g.randint(1000, 400000)), "oOrderkey": ("o_orderkey", lambda: g.randint(0, 1500)), "oOrderstatus": ("o_orderstatus", lambda: g.choice("FOP"))}
    ops = {"equalTo": "=", "notEqualTo": "<>", "lessThan": "<", "greaterThanOrEqualTo": ">=", "distinctFrom": "IS DISTINCT FROM"}

    def tree(level):
        if level and g.random() < 0.6:
            kind = g.choice(["and", "or", "not"])
            if kind == "not":
                f, s = tree(level - 1)
                return {"not": f}, f"NOT ({s})"
            parts = [tree(level - 1) for _ in range(2)]
            return {kind: [f for f, _ in parts]}, "(" + f" {kind.upper()} ".join(s for _, s in parts) + ")"
        field = g.choice(list(columns))
        name, value = columns[field]
        op = g.choice(["equalTo", "notEqualTo"]) if field == "oOrderstatus" else g.choice(list(ops))
        v = value()
        return {field: {op: v}}, f"{name} {ops[op]} {v!r}"

    for _ in range(12):
        f, s = tree(3)
        assert engine.connection("orders", f).total().first()[0] == duck.execute(f"SELECT count(*) FROM orders WHERE {s}").fetchone()[0], s


def test_plans(engine):
    plan = lambda df: df._jdf.queryExecution().toString()
    c = engine.connection("orders", {"oTotalprice": {"greaterThan": 1}, "linesExists": True}, select=["o_orderkey"], order=["O_TOTALPRICE_ASC"], first=5)
    text = plan(c.rows()[0])
    assert "LeftSemi" in text and "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1.0)" in text and "TakeOrderedAndProject" in text and "Cartesian" not in text
    assert "o_orderpriority" not in text.split("ReadSchema:")[1].split("\n")[0]
    none = plan(engine.connection("customer", {"ordersByOCustkey": {"none": {"oTotalprice": {"greaterThan": 1}}}}).filtered())
    assert "LeftAnti" in none
    either = plan(engine.connection("customer", {"or": [{"ordersByOCustkey": {"some": {"oTotalprice": {"greaterThan": 1}}}}, {"cAcctbal": {"lessThan": 0}}]}).filtered())
    assert "ExistenceJoin" in either
    assert "WindowGroupLimit" in plan(engine.connection("orders", distinct=["O_CUSTKEY"]).rows()[0])


def test_literals_and_wire():
    with pytest.raises(RequestError):
        literal("x", T.LongType())
    with pytest.raises(RequestError):
        literal(2**40, T.IntegerType())
    with pytest.raises(RequestError):
        literal("2024-13-01", T.DateType())
    assert wire(2**60, T.LongType()) == str(2**60) and wire(3, T.IntegerType()) == 3
    assert wire(decimal.Decimal("1.50"), T.DecimalType(5, 2)) == "1.50" and wire(b"\xde\xad", T.BinaryType()) == "dead"
    assert wire(datetime.datetime(2024, 1, 2, 3, 4, 5, 600), T.TimestampNTZType()) == "2024-01-02T03:04:05"
    assert wire([1, None], T.ArrayType(T.LongType())) == ["1", None] and wire('{"a": 1}', T.StringType(), "JSON") == {"a": 1}
    assert wire(float("nan"), T.DoubleType()) is None


def test_page_arguments():
    assert Page(first=0).size(100) == 100 and Page(first=-3).size(100) == 100 and Page(first=500).size(100) == 100 and Page().size(None) is None
    for bad in ({"first": 1, "last": 1}, {"last": 1, "offset": 1}, {"offset": -1}):
        with pytest.raises(RequestError):
            Page(**bad)


def test_empty_search(engine):
    assert data(engine, '{ search_documents(search: " !? ") { totalCount nodes { docId } pageInfo { hasNextPage } } }')["search_documents"] == {"totalCount": 0, "nodes": [], "pageInfo": {"hasNextPage": False}}


def test_search_pages(engine):
    query = '{ search_documents(search: "the", first: 7%s) { edges { cursor node { docId } } pageInfo { hasNextPage endCursor } } }'
    ids, after = [], ""
    while True:
        got = data(engine, query % after)["search_documents"]
        ids += [e["node"]["docId"] for e in got["edges"]]
        if not got["pageInfo"]["hasNextPage"]:
            break
        after = f', after: "{got["pageInfo"]["endCursor"]}"'
    want = [str(r["doc_id"]) for r in ranked(engine.scope("documents"), "the", 10_000).collect()]
    assert ids == want and len(ids) > 14
    assert engine.graphql('{ search_documents(search: "the", after: "e30=") { totalCount nodes { docId } } }')["errors"]


def test_change_stream(spark, engine, tmp_path):
    lines = ['{"id": "1", "mutation_type": "UPDATE"}', "not json", '{"id": "2", "mutation_type": "DELETE"}', '{"id": "3", "mutation_type": "INSERT", "_entity": "{\\"c_name\\": \\"own\\"}"}', '{"id": "4", "mutation_type": "WHAT"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    stream = spark.readStream.text(str(tmp_path / "in"))
    feed = engine.changes(feeds.parsed(stream), "customer", kinds=["UPDATE", "DELETE", "INSERT"])
    q = feed.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["id"]: r["_entity"] for r in spark.table("feed").collect()}
    assert set(got) == {"1", "2", "3"} and '"c_custkey":1' in got["1"] and got["2"] is None and got["3"] == '{"c_name": "own"}'


def test_stream_windows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = feeds.windowed_counts(stream, F.col("ts"), ["event_type"]).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_projects(spark, sf):
    root, name = sf.rsplit("/", 1)
    found = Catalog.from_project(spark, name, samples.DECLARED, (root + "/nowhere", root))
    assert set(found.entities) == set(samples.TABLES) and found.infer_enum("orders", "o_orderstatus") == ("F", "O", "P")
    with pytest.raises(RequestError):
        Catalog.from_project(spark, "nowhere", {}, (root,))
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation")
    assert "nation" in Catalog.from_project(spark, "shop", samples.DECLARED).entities
    spark.catalog.dropTempView("nation")


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).take(1)) == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_timeout(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    e = Engine(Catalog(spark, {"things": lambda: spark.range(2).select(slow("id").alias("id"))}, {"things": Declared(key=("id",))}), Options(timeout_s=2))
    assert "took more than 2 s" in e.graphql("{ things { nodes { id } } }")["errors"][0]["message"]


def test_refresh_and_health(spark, tmp_path):
    write = lambda name, df: df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    write("things", spark.range(3))
    for names in (None, ["things"]):
        e = Engine(Catalog.from_path(spark, str(tmp_path), names, {"things": Declared(key=("id",))}), Options(timeout_s=None))
        assert e.health() == {"status": "healthy", "tables": 1}
        write("things", spark.range(3).withColumn("extra", F.lit("x")))
        assert e.health()["changed"] == ["things"] and e.health()["status"] == "degraded"
        write("others", spark.range(2))
        assert e.health()["changed"] == ["others", "things"]
        e.refresh()
        assert e.health()["status"] == "healthy" and data(e, "{ things(first: 1) { nodes { id extra } } }")["things"]["nodes"] == [{"id": "0", "extra": "x"}]
        assert ("others" in e.catalog.entities) == (names is None)
        __import__("shutil").rmtree(tmp_path / "others.parquet")
        assert e.health() == {"status": "degraded", "tables": len(e.catalog.entities), "changed": ["others"]}
        e.refresh()
        assert e.health() == {"status": "healthy", "tables": 1}
        write("things", spark.range(3))
        e.refresh()
    __import__("shutil").rmtree(tmp_path / "things.parquet")
    assert e.health()["status"] == "unhealthy"


def test_refresh_by_notice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(3).write.parquet(str(tmp_path / "t" / "things.parquet"))
    e = Engine(Catalog.from_path(spark, str(tmp_path / "t"), None, {}), Options(timeout_s=None))
    spark.range(3).write.parquet(str(tmp_path / "t" / "more.parquet"))
    (tmp_path / "in" / "a.txt").write_text("schema_updated\n")
    q = e.follow(spark.readStream.text(str(tmp_path / "in"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert set(e.catalog.entities) == {"things", "more"}


def test_tags_in_comments(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS tagged_shop")
    for t in ("writers", "novels", "bios"):
        spark.sql(f"DROP TABLE IF EXISTS tagged_shop.{t}")
    spark.sql("CREATE TABLE tagged_shop.writers (id BIGINT, name STRING) USING parquet COMMENT '@search name'")
    spark.sql("CREATE TABLE tagged_shop.novels (id BIGINT, writer_id BIGINT, title STRING) USING parquet COMMENT '@foreignKey (writer_id) REFERENCES writers (id)|@foreignFieldName works'")
    spark.sql("CREATE TABLE tagged_shop.bios (id BIGINT, writer_id BIGINT COMMENT '@singleForeignFieldName bio') USING parquet")
    declared = {"writers": Declared(key=("id",)), "bios": Declared(key=("id",), foreign_keys=(ForeignKey("writer_id", "writers", "id"),), unique=(("writer_id",),))}
    c = Catalog.from_database(spark, "tagged_shop", declared)
    assert {r.name: (r.kind, r.table) for r in c.entity("writers").relations.values()} == {"works": ("backward", "novels"), "bio": ("single", "bios")}
    assert c.entity("novels").relations["writer"].there == "id"
    spark.sql("INSERT INTO tagged_shop.writers VALUES (1, 'Ann')")
    spark.sql("INSERT INTO tagged_shop.novels VALUES (5, 1, 'One')")
    assert data(Engine(c, Options(timeout_s=None)), "{ writers { nodes { name bio { id } works { nodes { title } } } } }")["writers"]["nodes"] == [{"name": "Ann", "bio": None, "works": {"nodes": [{"title": "One"}]}}]
    assert data(Engine(c, Options(timeout_s=None)), '{ search_writers(search: "ann") { nodes { name } } }')["search_writers"]["nodes"] == [{"name": "Ann"}]
    spark.sql("ALTER TABLE tagged_shop.writers ADD COLUMN born INT")
    e = Engine(c)
    assert e.health()["changed"] == ["writers"]
    e.refresh()
    assert "born" in e.catalog.entity("writers").columns and e.health()["status"] == "healthy"
    spark.sql("DROP DATABASE tagged_shop CASCADE")


def test_subscription(spark, small, tmp_path):
    from braidlake.engine import payloads

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id": "1", "mutation_type": "UPDATE"}\n{"id": "2", "mutation_type": "DELETE"}\n{"id": "3", "mutation_type": "UPDATE"}\n')
    feed = {"authors": feeds.parsed(spark.readStream.text(str(tmp_path / "in")))}
    query = "subscription S($ids: [ID!]) { a: authors(id: $ids, mutation: [UPDATE, DELETE]) { __typename id kind: mutation_type _entity { id name } } }"
    got = sorted(payloads(small.subscribe(query, feed, {"ids": [1, 2]}), str(tmp_path / "c"), 60, once=True))
    assert got == [
        '{"data":{"a":{"__typename":"AuthorSubscriptionPayload","id":"1","kind":"UPDATE","_entity":{"id":"1","name":"Ann"}}}}',
        '{"data":{"a":{"__typename":"AuthorSubscriptionPayload","id":"2","kind":"DELETE","_entity":null}}}',
    ]
    for bad in ("subscription { nope { id } }", "subscription { authors { id } books { id } }", "subscription { books { id } }", "{ authors { totalCount } }", "subscription { authors(mutation: [WHAT]) { id } }", "subscription { authors { what } }"):
        with pytest.raises(RequestError):
            small.subscribe(bad, feed)
    assert small.graphql("subscription { authors { id } }")["errors"]


def test_feed_of_one_table(spark):
    rows = [(channel("app", t, "entity_change"), f'{{"id": "{t}", "mutation_type": "INSERT"}}') for t in ("authors", "books")]
    assert [r["id"] for r in feeds.parsed(spark.createDataFrame(rows, "topic string, value string"), table=("app", "books")).collect()] == ["books"]


def test_service_and_point_argument(spark, small):
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = b'{"targetHeight": 99, "chain": "other", "what": 1}' if self.path == "/meta" else b"ok"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert service(url) == {"targetHeight": 99, "chain": "other"} and service("http://127.0.0.1:9", 0.2) == {}
    e = Engine(small.catalog, Options(timeout_s=None), lambda: service(url))
    assert data(e, "{ _metadata { chain targetHeight } }")["_metadata"] == {"chain": "main", "targetHeight": 99}
    server.shutdown()
    table = lambda: spark.createDataFrame([("historicalStateEnabled", '"timestamp"')], "key string, value string")
    by_time = Catalog(spark, small.catalog.sources, small.catalog.declared, {"_metadata": table})
    assert Engine(by_time, Options(point_argument=None)).options.point_argument == "timestamp" and Engine(small.catalog, Options(point_argument=None)).options.point_argument == "blockHeight"


def test_nested_distinct_is_in_order_of_the_keys(spark):
    books = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, 1, "b"), (4, 1, "c")], "id long, author_id long, kind string")
    e = Engine(Catalog(spark, {"authors": lambda: spark.range(1, 2), "books": lambda: books}, {"authors": Declared(key=("id",)), "books": Declared(key=("id",), foreign_keys=(ForeignKey("author_id", "authors", "id"),))}), Options(timeout_s=None))
    got = data(e, "{ books(distinct: [KIND], orderBy: ID_DESC) { nodes { id } } authors { nodes { booksByAuthorId(distinct: [KIND], orderBy: ID_DESC, first: 2) { nodes { id } } } } }")
    assert [b["id"] for b in got["books"]["nodes"]] == ["2", "3", "4"] and [b["id"] for b in got["authors"]["nodes"][0]["booksByAuthorId"]["nodes"]] == ["2", "3"]


_AT = datetime.datetime(2024, 1, 15, 10, 30)
_TYPES = [
    ("b", "boolean", True, True), ("i1", "tinyint", 7, 7), ("i2", "smallint", 32767, 32767), ("i4", "int", 2147483647, 2147483647), ("i8", "bigint", 9223372036854775807, "9223372036854775807"),
    ("f4", "float", 0.5, 0.5), ("f8", "double", 2.718281828459045, 2.718281828459045), ("n", "decimal(38,6)", decimal.Decimal("99999999999999.123456"), "99999999999999.123456"),
    ("t", "string", "hello", "hello"), ("y", "binary", b"\xde\xad\xbe\xef", "deadbeef"), ("j", "string", '{"nested": {"num": 42}}', {"nested": {"num": 42}}), ("ts", "timestamp_ntz", _AT, "2024-01-15T10:30:00"),
    ("tz", "timestamp", _AT.replace(tzinfo=datetime.UTC), "2024-01-15T10:30:00+00:00"), ("d", "date", _AT.date(), "2024-01-15"), ("tm", "string", "14:30:00", "14:30:00"), ("u", "string", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
    ("bit", "string", "10101010", "10101010"), ("ip", "string", "192.168.1.1", "192.168.1.1"), ("iv", "struct<years:int,months:int,days:int,hours:int,minutes:int,seconds:double>", (1, 2, 3, 4, 5, 6.0), {"years": 1, "months": 2, "days": 3, "hours": 4, "minutes": 5, "seconds": 6.0}),
    ("p", "struct<x:double,y:double>", (1.5, 2.5), {"x": 1.5, "y": 2.5}), ("bs", "array<boolean>", [True, None], [True, None]), ("is", "array<int>", [1, 2], [1, 2]), ("ls", "array<bigint>", [1], ["1"]), ("ds", "array<double>", [1.5], [1.5]), ("ns", "array<decimal(10,2)>", [decimal.Decimal("1.50")], ["1.50"]),
    ("xs", "array<string>", ["a"], ["a"]), ("tss", "array<timestamp_ntz>", [_AT], ["2024-01-15T10:30:00"]), ("days", "array<date>", [_AT.date()], ["2024-01-15"]), ("ys", "array<binary>", [b"\x01"], ["01"]), ("m", "map<string,bigint>", {"k": 1}, {"k": "1"}),
]
_NAMED = {"j": "JSON", "tm": "Time", "u": "UUID", "bit": "BitString", "ip": "InternetAddress", "iv": "Interval", "p": "Point"}


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(1, *(v for _, _, v, _ in _TYPES)), (2, *(None for _ in _TYPES))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"`{n}` {k}" for n, k, _, _ in _TYPES))
    return Engine(Catalog(spark, {"things": lambda: df}, {"things": Declared(key=("id",), scalars=_NAMED)}), Options(timeout_s=None))


def test_wire_of_every_type(typed):
    got = [n for n in typed.connection("things", first=5).fetch().rows]
    c = typed.connection("things", first=5)
    one, two = (c.fetch().node(r) for r in got)
    for name, _, _, want in _TYPES:
        assert one[name] == want, name
        assert two[name] is None, name


@pytest.mark.parametrize("name, operators", [
    ("b", {"equalTo": True}), ("i1", {"equalTo": 7}), ("i2", {"lessThanOrEqualTo": 32767}), ("i4", {"in": [1, 2147483647]}), ("i8", {"equalTo": "9223372036854775807"}), ("f4", {"greaterThan": 0.25}), ("f8", {"equalTo": 2.718281828459045}),
    ("n", {"equalTo": "99999999999999.123456"}), ("t", {"startsWithInsensitive": "HE"}), ("y", {"equalTo": "deadbeef"}), ("j", {"equalTo": {"nested": {"num": 42}}}), ("ts", {"equalTo": "2024-01-15T10:30:00"}), ("tz", {"lessThan": "2024-01-15T10:31:00Z"}),
    ("d", {"equalTo": "2024-01-15"}), ("tm", {"greaterThan": "14:00:00"}), ("u", {"equalTo": "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"}), ("bit", {"equalTo": "10101010"}), ("ip", {"in": ["192.168.1.1"]}), ("iv", {"equalTo": {"months": 2, "years": 1, "days": 3, "hours": 4, "minutes": 5, "seconds": 6}}),
    ("p", {"equalTo": {"x": 1.5, "y": 2.5}}), ("p", {"like": "(1.5,%"}), ("bs", {"some": {"equalTo": True}}), ("is", {"some": {"greaterThan": 1}}), ("ls", {"every": {"equalTo": "1"}}), ("xs", {"none": {"equalTo": "b"}}), ("days", {"some": {"equalTo": "2024-01-15"}}),
])
def test_filters_of_every_type(typed, name, operators):
    ids = lambda w: sorted(r["id"] for r in typed.connection("things", w).filtered().collect())
    assert ids({name: operators}) in ([1], [1, 2] if "none" in operators or "every" in operators else [1])
    if typed.catalog.entity("things").scalar(name) == "List":
        return
    assert ids({name: {"isNull": True}}) == [2]
    assert typed.connection("things", {"not": {name: operators}}).total().first()[0] == 0


@pytest.mark.parametrize("name, value", [("iv", "1 year"), ("iv", {"weeks": 1}), ("p", {"x": 1}), ("p", 3)])
def test_values_that_are_none_of_their_type(typed, name, value):
    with pytest.raises(RequestError):
        typed.connection("things", {name: {"equalTo": value}}).filtered()
