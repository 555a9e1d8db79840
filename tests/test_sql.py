"""SQL end to end: rows in, rows out."""

import pytest

from larkspur.engine import Engine


@pytest.fixture()
def db(spark):
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_basic(db):
    db.sql("CREATE TABLE boats (PRIMARY KEY (hull))")
    assert db.sql("INSERT INTO boats (hull, crew, name) VALUES (7, 3, 'Ibis'), (8, 12, 'Kestrel'), (9, 1, 'Wren')").first().affected == 3
    assert rows(db.sql("SELECT hull, crew + hull AS both, name FROM boats WHERE crew < 10 ORDER BY hull")) == [(7, 10, "Ibis"), (9, 10, "Wren")]
    db.sql("INSERT INTO boats (hull, name) VALUES (9, 'Tern')")  # replaces the whole row
    assert rows(db.sql("SELECT crew, name FROM boats WHERE hull = 9")) == [(None, "Tern")]
    assert db.sql("DELETE FROM boats WHERE crew >= 3 AND name LIKE 'K%'").first().affected == 1
    assert rows(db.sql("SELECT count(*), count(crew) FROM boats")) == [(2, 1)]
    with pytest.raises(KeyError):
        db.sql("SELECT * FROM nowhere")
    assert rows(db.sql("SELECT 7 - 2, 'o''clock'")) == [(5, "o'clock")]


def test_predicates_and_nulls(db):
    db.sql("CREATE TABLE herbs (PRIMARY KEY (no))")
    db.sql("INSERT INTO herbs (no, height, name) VALUES (10, 40, 'basil'), (20, 90, 'Borage'), (30, NULL, 'chervil'), (40, 12, NULL)")
    db.sql("INSERT INTO herbs (no, name) VALUES (50, 'bay')")
    ids = lambda w: [r[0] for r in rows(db.sql(f"SELECT no FROM herbs WHERE {w} ORDER BY no"))]
    assert ids("height >= 40") == [10, 20] and ids("NOT height >= 40") == [40]
    assert ids("height IS NULL") == [30, 50] and ids("height IS NOT NULL AND name IS NULL") == [40]
    assert ids("height IN (12, 13, 90)") == [20, 40] and ids("height NOT IN (12, NULL)") == []
    assert ids("height BETWEEN 12 AND 40") == [10, 40]
    assert ids("name LIKE 'b%'") == [10, 50] and ids("name ILIKE 'B%A%'") == [10, 20, 50] and ids("name NOT LIKE '%a%'") == [30]
    assert ids("name = 12") == []  # across types: NULL
    assert ids("height > 50 OR name = 'bay'") == [20, 50] and ids("unheard IS NULL") == [10, 20, 30, 40, 50]


def test_aggregates(db):
    db.sql("CREATE TABLE trips (PRIMARY KEY (n))")
    db.sql("INSERT INTO trips (n, line, km) VALUES (1,'red',4),(2,'blue',9),(3,'red',2),(4,'blue',1),(5,'red',6),(6,'tram',NULL)")
    assert rows(db.sql("SELECT line, sum(km) AS far FROM trips GROUP BY line HAVING far > 11 ORDER BY far DESC")) == [("red", 12)]
    assert rows(db.sql("SELECT avg(km), min(km), max(km), count(km), count(DISTINCT line) FROM trips")) == [(4.4, 1, 9, 5, 3)]
    assert rows(db.sql("SELECT count(*), max(km) FROM trips WHERE n > 50")) == [(0, None)]
    assert rows(db.sql("SELECT percentile(km, 0.5) AS p FROM trips WHERE line = 'blue'")) == [(5.0,)]
    assert rows(db.sql("SELECT line, n FROM trips GROUP BY line TOP 1 BY km ASC ORDER BY line")) == [("blue", 4), ("red", 3), ("tram", 6)]


def test_order_and_limit(db):
    db.sql("CREATE TABLE peaks (PRIMARY KEY (id))")
    db.sql("INSERT INTO peaks (id, height) VALUES (5, 800), (6, 300), (7, NULL), (8, 800), (9, 650)")
    ids = lambda text, *p: [r[0] for r in rows(db.sql(f"SELECT id FROM peaks {text}", *p))]
    assert ids("ORDER BY height") == [6, 9, 5, 8, 7] and ids("ORDER BY height DESC") == [7, 5, 8, 9, 6]
    assert ids("ORDER BY height LIMIT 2 OFFSET 1") == [9, 5]
    assert rows(db.sql("SELECT DISTINCT height FROM peaks ORDER BY height")) == [(300,), (650,), (800,), (None,)]
    assert ids("WHERE height IS NOT NULL ORDER BY height DESC AFTER (800, 5) LIMIT 5") == [8, 9, 6]
    assert ids("WHERE height = ? ORDER BY id LIMIT ?", 800, 1) == [5]


def test_rows_leave_with_time(db):
    import time

    db.sql("CREATE TABLE brief (PRIMARY KEY (id)) WITH (ttl = 600ms)")
    db.sql("CREATE TABLE lasting (PRIMARY KEY (id))")
    for t in ("brief", "lasting"):
        db.sql(f"INSERT INTO {t} (id, v) VALUES (1, 'a'), (2, 'b')")
    assert rows(db.sql("SELECT count(*) FROM brief")) == [(2,)]
    time.sleep(0.7)
    assert rows(db.sql("SELECT id FROM brief")) == [] and rows(db.sql("SELECT count(*) FROM brief")) == [(0,)]
    assert db.sql("UPDATE brief SET v = 'c'").first().affected == 0 and db.sql("DELETE FROM brief").first().affected == 0
    db.sql("INSERT INTO brief (id, v) VALUES (3, 'd')")
    assert rows(db.sql("SELECT id FROM brief")) == [(3,)]
    db.sql("ALTER TABLE lasting SET (ttl = 100ms)")
    assert rows(db.sql("SELECT count(*) FROM lasting")) == [(0,)]
    db.sql("ALTER TABLE lasting SET (ttl = 1d)")
    assert rows(db.sql("SELECT id FROM lasting ORDER BY id")) == [(1,), (2,)]
    assert "_written_at" not in db.sql("SELECT * FROM lasting").columns


def test_many_statements_keep_a_short_plan(db):
    from larkspur.engine import DEPTH

    db.sql("CREATE TABLE log (PRIMARY KEY (id))")
    for k in range(3 * DEPTH):
        db.sql("INSERT INTO log (id, v) VALUES (?, ?)", k % 20, k)
    assert db.table("log").depth < DEPTH
    assert len(db.table("log").rows._jdf.queryExecution().analyzed().toString().splitlines()) < 12 * DEPTH
    assert sorted(rows(db.sql("SELECT id, v FROM log"))) == [(k, max(x for x in range(3 * DEPTH) if x % 20 == k)) for k in range(20)]


def test_values_of_several_types(db):
    db.sql("CREATE TABLE mixed (PRIMARY KEY (id))")
    db.sql("INSERT INTO mixed (id, x, y, z) VALUES (1, 1, NULL, 'a'), (2, 2.5, NULL, NULL), (3, NULL, NULL, 'c')")
    assert rows(db.sql("SELECT id, x, y, z FROM mixed ORDER BY id")) == [(1, 1.0, None, "a"), (2, 2.5, None, None), (3, None, None, "c")]
    db.sql("INSERT INTO mixed (id, y) VALUES (4, true)")
    assert rows(db.sql("SELECT y, x FROM mixed WHERE id = 4")) == [(True, None)]
    with pytest.raises(SyntaxError):
        db.sql("INSERT INTO mixed (id, x) VALUES (5)")


def test_stream_prepare_batch_and_memory(db):
    db.sql("CREATE TABLE nums (PRIMARY KEY (id)) WITH (memory = true)")
    put = db.prepare("INSERT INTO nums (id, v) VALUES (?, ?)")
    for k in range(5):
        put(k, k * k)
    assert db.table("nums").rows.is_cached
    header, *chunks = db.stream("SELECT id, v FROM nums ORDER BY id", chunk=2)
    assert header == ["id", "v"] and chunks == [[(0, 0), (1, 1)], [(2, 4), (3, 9)], [(4, 16)]]
    assert rows(db.batch(("DELETE FROM nums WHERE v > ?", 3), "SELECT count(*) FROM nums")[1]) == [(2,)]
    with pytest.raises(Exception):
        db.prepare("SELECT FROM WHERE ?")


def test_a_search_sees_later_writes(db):
    db.sql("CREATE TABLE notes (PRIMARY KEY (id))")
    db.sql("INSERT INTO notes (id, body, tag) VALUES (1, 'Red fox', 'A b'), (2, 'grey wolf', 'c')")
    db.sql("CREATE SEARCH INDEX ix ON notes (body, tag) WITH (body.analyzer = 'english', tag.type = 'keyword')")
    found = lambda w: sorted(r[0] for r in rows(db.sql(f"SELECT id FROM notes WHERE {w}")))
    assert found("MATCH(body, 'foxes')") == [1] and found("MATCH(tag, 'A b')") == [1] and found("MATCH(tag, 'A')") == []
    kept = db.search_index("notes")
    assert db.search_index("notes") is kept  # built once
    db.sql("INSERT INTO notes (id, body) VALUES (3, 'two Foxes')")
    assert found("MATCH(body, 'fox')") == [1, 3] and db.search_index("notes") is not kept
    a = db.sql("SELECT HIGHLIGHT(body) AS h FROM notes WHERE MATCH(body, 'wolf')")
    b = db.sql("SELECT HIGHLIGHT(body) AS h FROM notes WHERE MATCH(body, 'red')")
    assert rows(a) == [("grey <b>wolf</b>",)] and rows(b) == [("<b>Red</b> fox",)]  # each its own terms


def test_joins_and_unions(db):
    db.sql("CREATE TABLE users (PRIMARY KEY (id))")
    db.sql("CREATE TABLE orders (PRIMARY KEY (oid))")
    db.sql("INSERT INTO users (id, name) VALUES (1,'ann'),(2,'bob'),(3,'cy')")
    db.sql("INSERT INTO orders (oid, uid, amt) VALUES (10,1,5),(11,1,7),(12,2,9),(13,9,1)")
    assert rows(db.sql("SELECT u.name, o.amt FROM users u JOIN orders o ON u.id = o.uid ORDER BY o.oid")) == [("ann", 5), ("ann", 7), ("bob", 9)]
    assert sorted(map(str, rows(db.sql("SELECT u.name, o.oid FROM users u LEFT JOIN orders o ON u.id = o.uid")))) == ["('ann', 10)", "('ann', 11)", "('bob', 12)", "('cy', None)"]
    assert rows(db.sql("SELECT o.oid FROM users u RIGHT JOIN orders o ON u.id = o.uid WHERE u.id IS NULL")) == [(13,)]
    assert rows(db.sql("SELECT count(*) FROM users CROSS JOIN orders")) == [(12,)]
    assert sorted(rows(db.sql("SELECT id FROM users UNION SELECT uid FROM orders"))) == [(1,), (2,), (3,), (9,)]
    assert len(rows(db.sql("SELECT id FROM users UNION ALL SELECT uid FROM orders"))) == 7
    assert rows(db.sql("SELECT u.name, sum(o.amt) AS s FROM users u JOIN orders o ON u.id = o.uid GROUP BY u.name ORDER BY s DESC LIMIT 1")) == [("ann", 12)]


def test_documents(db):
    db.sql("CREATE TABLE d (PRIMARY KEY (id))")
    db.sql("INSERT INTO d (id, meta, tags) VALUES (1, {name: 'x', addr: {city: 'Rome'}}, ['a', 'b']), (2, {name: 'y', addr: {city: 'Oslo'}}, ['c'])")
    assert rows(db.sql("SELECT id FROM d WHERE meta.addr.city = 'Oslo'")) == [(2,)]
    assert rows(db.sql("SELECT id FROM d WHERE tags = 'a'")) == [(1,)]
    assert rows(db.sql("SELECT id FROM d WHERE tags IN ('c', 'z')")) == [(2,)]
    db.sql("UPDATE d SET meta.addr.city = 'Bern' WHERE id = 1")
    assert rows(db.sql("SELECT meta.addr.city AS city FROM d ORDER BY id")) == [("Bern",), ("Oslo",)]


def test_functions(db):
    one = lambda e: rows(db.sql(f"SELECT {e} AS x"))[0][0]
    assert one("7 / 2") == 3 and one("-7 / 2") == -3 and one("1 / 0") is None and one("7.0 / 2") == 3.5
    assert one("to_int('12.9')") == 12 and one("to_int('x')") is None
    assert one("to_bool('T')") is True and one("to_bool('yes')") is None
    assert one("CAST('2024-01-02T03:04:05.678Z' AS STRING)") == "2024-01-02T03:04:05.678Z"
    assert one("to_string(to_timestamp('2024-01-02T03:04:05.678Z'))") == "2024-01-02T03:04:05.678Z"
    assert one("to_timestamp('junk')") is None
    assert one("time_bucket(1m, 125000)") == 120000 and one("time_bucket(1m, -1)") == -60000
    assert one("distance('2km')") == 2000.0
    assert round(one("geo_distance({lat: 48.8566, lon: 2.3522}, 51.5074, -0.1278)")) in range(343_000, 344_500)
    assert one("geo_bbox([10.0, 179.5], 0, 170, 20, -170)") is True
    with pytest.raises(ValueError):
        one("nosuch(1)")
    with pytest.raises(ValueError):
        one("time_bucket(0, 5)")


def test_timeseries(db):
    db.sql("CREATE TIMESERIES TABLE cpu SERIES KEY (host, core) RETENTION 30d OOO 1m")
    values = ", ".join(f"('{h}', '{c}', {i * 15000}, {15.0 * i})" for h in "ab" for c in "01" for i in range(8))
    assert db.sql(f"INSERT INTO cpu (host, core, ts, value) VALUES {values}").first().affected == 32
    assert rows(db.sql("SELECT count(*) FROM cpu")) == [(32,)]
    assert rows(db.sql("SELECT host, rate(value) AS r FROM cpu GROUP BY host ORDER BY host")) == [("a", 2.0), ("b", 2.0)]
    assert rows(db.sql("SELECT time_bucket(1m, ts) AS t, max(value) AS m, last(value) AS l FROM cpu GROUP BY t ORDER BY t")) == [(0, 45.0, 45.0), (60000, 105.0, 105.0)]
    assert db.sql("INSERT INTO cpu (host, core, ts, value) VALUES ('a','0',1000,1.0)").first().affected == 0  # too late
    assert db.sql("INSERT INTO cpu (host, core, ts, value) VALUES ('a','0',100000,1.0)").first().affected == 1
    with pytest.raises(ValueError):
        db.sql("UPDATE cpu SET value = 1.0")
    assert rows(db.sql("SELECT DISTINCT host FROM cpu ORDER BY host")) == [("a",), ("b",)]
    db.sql("CREATE ROLLUP cpu_1m ON cpu BUCKET 1m")
    assert rows(db.sql("SELECT sum(value_count) AS n FROM cpu_1m")) == [(33,)]
    got = db.promql('sum by (host) (rate(value{core="1"}[1m]))', 105000).collect()
    assert sorted((r.labels["host"], r.value) for r in got) == [("a", 1.0), ("b", 1.0)]


def test_counter_reset(db):
    db.sql("CREATE TIMESERIES TABLE reqs SERIES KEY (h)")
    db.sql("INSERT INTO reqs (h, ts, value) VALUES ('x', 0, 0.0), ('x', 1000, 10.0), ('x', 2000, 3.0)")
    assert rows(db.sql("SELECT increase(value) AS i, delta(value) AS d FROM reqs")) == [(13.0, 3.0)]


def docs(db):
    db.sql("CREATE TABLE docs (PRIMARY KEY (id))")
    db.sql("INSERT INTO docs (id, body, n, emb) VALUES (1, 'the quick brown fox', 3, [1.0, 0.0]), (2, 'the lazy brown dog', 1, [0.0, 1.0]), (3, 'quick quick silver', 2, [0.9, 0.1])")
    db.sql("CREATE SEARCH INDEX ix ON docs (body)")


def test_search(db):
    docs(db)
    q = lambda w, tail="": rows(db.sql(f"SELECT id FROM docs WHERE {w} {tail}"))
    assert q("MATCH(body, 'quick')", "ORDER BY score() DESC LIMIT 5") == [(3,), (1,)]
    assert sorted(q("MATCH(body, 'brown') AND NOT MATCH(body, 'fox')")) == [(2,)]
    assert q("MATCH_PHRASE(body, 'brown fox')") == [(1,)]
    assert q("MATCH_PHRASE(body, 'quick fox', 1)") == [(1,)]
    assert q("FUZZY(body, 'qiuck', 1)", "ORDER BY id") == [(1,), (3,)]
    assert q("WILDCARD(body, 'l?zy')") == [(2,)]
    assert q("REGEXP(body, 'sil.*')") == [(3,)]
    assert q("MATCH_PREFIX(body, 'bro')", "ORDER BY id") == [(1,), (2,)]
    assert q("SEARCH('+brown -lazy')") == [(1,)]
    assert q("MATCH(body, 'brown') AND n > 2") == [(1,)]
    assert rows(db.sql("SELECT count(*) FROM docs WHERE MATCH(body, 'the')")) == [(2,)]
    assert rows(db.sql("SELECT HIGHLIGHT(body) AS h FROM docs WHERE MATCH(body, 'fox')")) == [("the quick brown <b>fox</b>",)]
    got = rows(db.sql("SUGGEST 'quikc' ON ix LIMIT 2"))
    assert got[0][:3] == ("quikc", "quick", 1)


def test_vector_and_hybrid(db):
    docs(db)
    assert rows(db.sql("SELECT id FROM docs NEAREST(emb, [1.0, 0.0], 2)")) == [(1,), (3,)]
    assert rows(db.sql("SELECT id FROM docs NEAREST(emb, [1.0, 0.0], 2) WHERE n < 3")) == [(3,), (2,)]
    assert rows(db.sql("SELECT id FROM docs NEAREST(emb, [1.0, 0.0], 3) WHERE MATCH(body, 'quick') RANK BY RRF LIMIT 2")) == [(1,), (3,)]
    got = rows(db.sql("SELECT id FROM docs NEAREST(emb, [0.0, 1.0], 3) RERANK ON body QUERY 'silver' TOP 3"))
    assert got[0] == (3,)


def test_transactions_and_catalog(db, tmp_path):
    db.sql("CREATE TABLE t (PRIMARY KEY (id))")
    db.sql("INSERT INTO t (id, v) VALUES (1, 1)")
    db.sql("BEGIN")
    db.sql("INSERT INTO t (id, v) VALUES (2, 2)")
    assert rows(db.sql("SELECT count(*) FROM t")) == [(2,)]
    db.sql("ROLLBACK")
    assert rows(db.sql("SELECT count(*) FROM t")) == [(1,)]
    db.sql("CREATE DATABASE other")
    db.sql("USE other")
    with pytest.raises(KeyError):
        db.sql("SELECT * FROM t")
    assert rows(db.sql("SELECT v FROM default.t")) == [(1,)]
    db.sql("USE default")
    db.sql("ALTER TABLE t RENAME COLUMN v TO w")
    assert db.sql("SELECT * FROM t").columns == ["id", "w"]
    db.sql(f"BACKUP TO '{tmp_path}/b'")
    db.sql("DROP TABLE t")
    db.sql(f"RESTORE FROM '{tmp_path}/b'")
    assert rows(db.sql("SELECT w FROM t")) == [(1,)]
    assert ("t", "table") in rows(db.sql("SHOW TABLES"))
    assert db.sql("DESCRIBE t FULL").count() == 2
    assert db.sql("EXPLAIN SELECT * FROM t WHERE id = 1").count() > 0


def test_a_vector_index_sets_the_metric(db):
    db.sql("CREATE TABLE pts (PRIMARY KEY (id))")
    db.sql("INSERT INTO pts (id, v) VALUES (1, [10.0, 1.0]), (2, [1.0, 1.0])")
    near = "SELECT id FROM pts NEAREST(v, [1.0, 0.0], 1)"
    assert rows(db.sql(near)) == [(1,)]  # by angle
    db.sql("CREATE VECTOR INDEX pv ON pts (v) DIM 2 USING l2 QUANTIZED")
    assert rows(db.sql(near)) == [(2,)]  # by distance


def test_explain_decides_and_does_not_run(db):
    db.sql("CREATE TABLE tools (PRIMARY KEY (id))")
    db.sql("INSERT INTO tools (id, age, body, emb) VALUES (1, 30, 'claw hammer', [1.0, 0.0]), (2, 40, 'saw', [0.0, 1.0])")
    db.sql("CREATE INDEX by_age ON tools (age)")
    db.sql("CREATE SEARCH INDEX words ON tools (body)")
    db.sql("CREATE VECTOR INDEX near ON tools (emb) DIM 2")
    decision = lambda text: dict(rows(db.sql(f"EXPLAIN {text}").where("aspect <> 'plan'")))["access"]
    assert db.sql("EXPLAIN SELECT id FROM tools").columns == ["aspect", "decision"]
    assert "point read" in decision("SELECT * FROM tools WHERE id = 1") and "point reads" in decision("SELECT * FROM tools WHERE id IN (1, 2)")
    assert "by_age" in decision("SELECT * FROM tools WHERE age > 10") and decision("SELECT * FROM tools WHERE nope = 'x'") == "full table scan"
    assert "BM25 top-k" in decision("SELECT id, score() FROM tools WHERE MATCH(body, 'saw') ORDER BY score() DESC LIMIT 5")
    assert "aggregation" in decision("SELECT count(*) FROM tools WHERE MATCH(body, 'saw') GROUP BY age")
    assert "near" in decision("SELECT id FROM tools NEAREST(emb, [1.0, 0.0], 1)") and "point read" in decision("DELETE FROM tools WHERE id = 1")
    assert rows(db.sql("SELECT count(*) FROM tools")) == [(2,)]
    for bad in ("EXPLAIN EXPLAIN SELECT * FROM tools", "EXPLAIN CREATE TABLE more (PRIMARY KEY (id))"):
        with pytest.raises((ValueError, SyntaxError)):
            db.sql(bad)
