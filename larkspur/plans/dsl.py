"""A JSON search DSL: request bodies to the engine's syntax tree, answers as hits and aggregations."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalar import distance, duration
from larkspur.operators import relational as R
from larkspur.operators import search as Q
from larkspur.operators import vector as V
from larkspur.plans import sql as A

#: The percentiles that a request without any gets.
PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)

#: Buckets that one aggregation may answer with; beyond that it is refused.
MAX_BUCKETS = 65_536


def _one(kind: str, body: dict) -> tuple[str, Any]:
    if not isinstance(body, dict) or not body:
        raise ValueError(f"{kind} needs a field")
    return next(iter(body.items()))


def _text(spec: Any) -> str:
    return str(spec.get("query", spec.get("value")) if isinstance(spec, dict) else spec)


def _all(parts: list) -> Any:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else A.Bin("and", out, p)
    return out


def _any(parts: list) -> Any:
    out = None
    for p in parts:
        out = p if out is None else A.Bin("or", out, p)
    return out


def _list(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def point(p: Any) -> tuple[float, float]:
    """Latitude and longitude of {lat, lon}, "lat,lon" or [lon, lat]."""
    if isinstance(p, dict):
        return float(p["lat"]), float(p.get("lon", p.get("lng")))
    if isinstance(p, str):
        a, b = p.split(",")
        return float(a), float(b)
    return float(p[1]), float(p[0])


def expression(q: dict) -> Any:
    """The predicate of a query; None for match_all."""
    if not q:
        return None
    kind, body = next(iter(q.items()))
    if kind == "match_all":
        return None
    if kind in ("match", "match_phrase", "match_phrase_prefix", "prefix", "wildcard", "regexp", "fuzzy"):
        name, spec = _one(kind, body)
        more = []
        if isinstance(spec, dict):
            more = [A.Lit(int(spec[k])) for k in ("slop", "fuzziness") if str(spec.get(k, "")).isdigit()]
        call = {"match_phrase_prefix": "match_prefix", "prefix": "match_prefix"}.get(kind, kind)
        return A.Func(call, [A.Col(name), A.Lit(_text(spec)), *more])
    if kind == "more_like_this":
        return A.Func("more_like_this", [A.Col(body["fields"][0]), A.Lit(body["like"])])
    if kind == "query_string":
        return A.Func("search", [A.Lit(body["query"])])
    if kind == "multi_match":
        fields, text, way = body["fields"], A.Lit(body["query"]), body.get("type", "best_fields")
        if any("^" in f for f in fields):
            raise ValueError("boosts are options of the index")
        if len(fields) == 1:
            return A.Func("match", [A.Col(fields[0]), text])
        if way == "most_fields":
            return _any([A.Func("match", [A.Col(f), text]) for f in fields])
        if way not in ("best_fields", "cross_fields"):
            raise ValueError(f"no multi_match of type {way}")
        return A.Func("match_best" if way == "best_fields" else "match_cross", [*map(A.Col, fields), text])
    if kind == "term":
        name, spec = _one(kind, body)
        return A.Bin("=", A.Col(name), A.Lit(spec["value"] if isinstance(spec, dict) else spec))
    if kind == "terms":
        name, values = _one(kind, body)
        return _any([A.Bin("=", A.Col(name), A.Lit(v)) for v in values])
    if kind == "range":
        name, bounds = _one(kind, body)
        ops = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
        return _all([A.Bin(ops[k], A.Col(name), A.Lit(v)) for k, v in bounds.items() if k in ops])
    if kind == "exists":
        return A.IsNull(A.Col(body["field"]), True)
    if kind == "geo_distance":
        name = next(k for k in body if k not in ("distance", "distance_type", "validation_method"))
        lat, lon = point(body[name])
        return A.Bin("<=", A.Func("geo_distance", [A.Col(name), A.Lit(lat), A.Lit(lon)]), A.Lit(distance(body["distance"])))
    if kind == "geo_bounding_box":
        name = next(k for k in body if k not in ("validation_method", "type"))
        box = body[name]
        if "top_left" in box:
            (n, w), (s, e) = point(box["top_left"]), point(box["bottom_right"])
        elif "top_right" in box:
            (n, e), (s, w) = point(box["top_right"]), point(box["bottom_left"])
        else:
            n, w, s, e = (float(box[k]) for k in ("top", "left", "bottom", "right"))
        return A.Func("geo_bbox", [A.Col(name), *map(A.Lit, (s, w, n, e))])
    if kind == "bool":
        need = [expression(x) for c in ("must", "filter") for x in _list(body.get(c))]
        need += [A.Un("not", expression(x)) for x in _list(body.get("must_not"))]
        may = [e for e in map(expression, _list(body.get("should"))) if e is not None]
        if not may:
            return _all(need)
        least = int(body.get("minimum_should_match", 0 if [n for n in need if n is not None] else 1))
        if not [n for n in need if n is not None]:
            return _any(may)
        if least == 1:
            return _all([*need, _any(may)])
        if least != 0:
            raise ValueError("minimum_should_match is 0 or 1")
        found = [n for n in need if n is not None and is_search(n)]
        if not found:
            raise ValueError("should beside clauses without a score needs minimum_should_match: 1")
        return _all([*(n for n in need if n is not None and not is_search(n)), A.Func("boosted", [_all(found), *may])])
    raise ValueError(f"no query {kind!r}")


def is_search(e: Any) -> bool:
    return any(isinstance(x, A.Func) and x.name in A.SEARCH for x in A.walk(e))


# --- aggregations --------------------------------------------------------------------------------------------


def metric(kind: str, body: dict):
    c = F.col(body["field"])
    if kind == "percentiles":
        ps = [float(p) for p in body.get("percents", PERCENTS)]
        return F.array(*(R.percentile(c, p / 100) for p in ps)), ps
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "value_count": F.count, "cardinality": F.count_distinct}[kind](c), None


def aggregate(rows: DataFrame, pk: str, specs: dict) -> dict:
    out = {}
    for name, spec in specs.items():
        kind, body = next((k, v) for k, v in spec.items() if k not in ("aggs", "aggregations"))
        inner = spec.get("aggs") or spec.get("aggregations") or {}
        if kind in ("terms", "date_histogram", "composite"):
            out[name] = buckets(rows, pk, kind, body, inner)
        else:
            c, ps = metric(kind, body)
            v = rows.agg(c.alias("v")).first()["v"]
            out[name] = {"values": {f"{p}": x for p, x in zip(ps, v, strict=True)}} if ps else {"value": v}
    return out


def buckets(rows: DataFrame, pk: str, kind: str, body: dict, inner: dict) -> dict:
    """Groups with counts and inner metrics; as many come to the driver as the request asks for."""
    from larkspur.operators.timeseries import bucketed

    if kind == "composite":
        sources = [(n, *next(iter(s.items()))) for x in body["sources"] for n, s in x.items()]
        for n, how, b in sources:
            rows = bucketed(rows, b["fixed_interval"], b["field"], f"_k_{n}") if how == "date_histogram" else rows.withColumn(f"_k_{n}", F.col(b["field"]))
        keys = [f"_k_{n}" for n, _, _ in sources]
    elif kind == "date_histogram":
        rows, keys = bucketed(rows, duration(body.get("fixed_interval") or body["interval"]), body["field"], "_k"), ["_k"]
    else:
        rows, keys = rows.withColumn("_k", F.col(body["field"])).where("_k is not null"), ["_k"]
    made, percents, hits = [F.count(F.lit(1)).alias("_n")], {}, {}
    for name, spec in inner.items():
        k, b = next(iter(spec.items()))
        if k == "top_hits":
            hits[name] = b
            continue
        c, percents[name] = metric(k, b)
        made.append(c.alias(f"_m_{name}"))
    found = rows.groupBy(*keys).agg(*made)
    if kind == "terms":
        found = found.orderBy(F.col("_n").desc(), F.col("_k").asc()).limit(int(body.get("size", 10)))
    elif kind == "composite":
        found = found.orderBy(*(F.col(k).asc_nulls_first() for k in keys))
        if body.get("after"):
            last = [body["after"][n] for n, _, _ in sources]
            beyond = F.lit(False)
            for i in range(len(keys)):
                same = F.lit(True)
                for j in range(i):
                    same = same & F.col(keys[j]).eqNullSafe(F.lit(last[j]))
                beyond = beyond | (same & (F.col(keys[i]) > F.lit(last[i])))
            found = found.where(beyond)
        found = found.limit(int(body.get("size", 10)))
    else:
        found = found.orderBy("_k")
    got = found.limit(MAX_BUCKETS + 1).collect()
    if len(got) > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    tops: dict = {}
    for name, b in hits.items():
        by, way = next(iter((_list(b.get("sort")) or [{pk: "asc"}])[0].items()))
        way = way["order"] if isinstance(way, dict) else way
        best = R.top_k_per_group(rows.join(F.broadcast(found.select(*keys)), keys, "left_semi"), keys, by, int(b.get("size", 3)), way, [pk])
        for r in best.collect():  # buckets x size rows
            tops.setdefault(name, {}).setdefault(tuple(r[k] for k in keys), []).append({"_source": source(r, keys)})
    out = []
    for r in got:
        key = {n: r[k] for (n, _, _), k in zip(sources, keys, strict=True)} if kind == "composite" else r["_k"]
        one = {"key": key, "doc_count": r["_n"]}
        for name in inner:
            if name in hits:
                one[name] = {"hits": {"hits": tops.get(name, {}).get(tuple(r[k] for k in keys), [])}}
            elif percents[name]:
                one[name] = {"values": {f"{p}": x for p, x in zip(percents[name], r[f"_m_{name}"], strict=True)}}
            else:
                one[name] = {"value": r[f"_m_{name}"]}
        out.append(one)
    result: dict = {"buckets": out}
    if kind == "composite" and out:
        result["after_key"] = out[-1]["key"]
    return result


def source(row, drop=(), only: list | None = None) -> dict:
    return {k: v for k, v in row.asDict(recursive=True).items() if not k.startswith("_") and k not in drop and v is not None and (only is None or k in only)}


# --- requests ------------------------------------------------------------------------------------------------


def search(engine, table: str, body: dict) -> dict:
    """Answers a _search request: hits, exact total, aggregations, highlights."""
    from larkspur.engine import Lower, Planner

    t = engine.table(table)
    pk = t.pk[0]
    where = expression(body.get("query") or {})
    size, start = int(body.get("size", 10)), int(body.get("from", 0))
    if "retriever" in body:
        return retrieve(engine, table, body)
    if "knn" in body:
        knn = body["knn"]
        rows = engine.rows(table)
        cond = expression(knn.get("filter") or {})
        near = V.nearest(rows, knn["field"], knn["query_vector"], int(knn.get("k", 10)), pk, where=None if cond is None else Lower(engine, rows).expr(cond)[0])
        rows = near.withColumn("_score", 1 / (1 + F.col("_distance")))
    else:
        s = A.Select([A.Item(A.Col("*"), None)], table, table, where=where)
        rows = engine.rows(table).alias(table)
        rows, _ = Planner(engine, s).filtered(s, rows, Lower(engine, rows, {table: rows}))
        if "_score" not in rows.columns:
            rows = rows.withColumn("_score", F.lit(1.0))
    out: dict = {"hits": {"total": {"value": rows.count(), "relation": "eq"}, "hits": []}}
    specs = body.get("aggs") or body.get("aggregations")
    if specs:
        out["aggregations"] = aggregate(rows, pk, specs)
    keys = []
    for k in _list(body.get("sort")):
        name, way = (k, "desc" if k == "_score" else "asc") if isinstance(k, str) else next(iter(k.items()))
        keys.append((name, way["order"] if isinstance(way, dict) else way))
    by = keys or [("_score", "desc")]
    if after := body.get("search_after"):
        (name, way), last = by[0], after[0]
        beyond = F.col(name) > F.lit(last) if way == "asc" else F.col(name) < F.lit(last)
        if len(after) > 1:
            beyond = beyond | ((F.col(name) == F.lit(last)) & (F.col(pk) > F.lit(after[1])))
        rows = rows.where(beyond)
    page = R.order_by(rows, *by, pk=[pk], limit=size, offset=start)
    marked = body.get("highlight", {}).get("fields", {})
    for f, o in marked.items():
        ix = engine.search_index(table)
        terms = [x for c in A.walk(where) if isinstance(c, A.Func) and c.name in A.SEARCH and isinstance(c.args[-1], A.Lit) for x in ix.field(f).query_terms(str(c.args[-1].value))]
        opt = {**body["highlight"], **o}
        page = page.withColumn(f"_h_{f}", Q.highlight(F.col(f), terms, ix.field(f).analyzer, size=int(opt.get("fragment_size", 150)), count=int(opt.get("number_of_fragments", 1)), pre=(opt.get("pre_tags") or ["<b>"])[0], post=(opt.get("post_tags") or ["</b>"])[0]))
    only = body.get("_source") if isinstance(body.get("_source"), list) else None
    for r in page.collect():  # one page
        hit = {"_id": str(r[pk]), "_score": r["_score"], "_source": {} if body.get("_source") is False else source(r, only=only)}
        if keys:
            hit["sort"] = [r[n] for n, _ in keys] + [r[pk]]
        if marked:
            hit["highlight"] = {f: _list(r[f"_h_{f}"]) for f in marked}
        out["hits"]["hits"].append(hit)
    return out


def retrieve(engine, table: str, body: dict) -> dict:
    """retriever: rrf of standard and knn retrievers, optionally reranked by text."""
    spec, pk = body["retriever"], engine.table(table).pk[0]
    if "text_similarity_reranker" in spec:
        r = spec["text_similarity_reranker"]
        first = retrieve_rows(engine, table, r["retriever"], int(r.get("rank_window_size", 100)))
        rows = V.rerank(first, F.col("_score").desc(), pk, r["field"], r["inference_text"], int(r.get("rank_window_size", 100)), int(body.get("size", 10))).withColumn("_score", F.col("_rerank"))
    else:
        rows = retrieve_rows(engine, table, spec, int(body.get("size", 10)))
    hits = [{"_id": str(r[pk]), "_score": r["_score"], "_source": source(r)} for r in R.order_by(rows, ("_score", "desc"), pk=[pk], limit=int(body.get("size", 10))).collect()]
    return {"hits": {"total": {"value": len(hits), "relation": "eq"}, "hits": hits}}


def retrieve_rows(engine, table: str, spec: dict, k: int) -> DataFrame:
    pk, rows = engine.table(table).pk[0], engine.rows(table)
    kind, body = next(iter(spec.items()))
    if kind == "knn":
        near = V.nearest(rows, body["field"], body["query_vector"], int(body.get("k", k)), pk)
        return near.withColumn("_score", 1 / (1 + F.col("_distance")))
    if kind == "standard":
        return Q.search(engine.search_index(table), _query(engine, table, body["query"]), k)
    if kind == "rrf":
        legs = []
        for r in body["retrievers"]:
            part = retrieve_rows(engine, table, r, int(body.get("rank_window_size", k)))
            legs.append(V.ranked(part, F.col("_score").desc(), pk, int(body.get("rank_window_size", k))))
        fused = V.rrf(legs, pk, k, int(body.get("rank_constant", 60)))
        return rows.join(fused, pk).withColumn("_score", F.col("_rrf_score"))
    raise ValueError(f"no retriever {kind!r}")


def _query(engine, table: str, q: dict) -> Q.Query:
    from larkspur.engine import Planner

    return Planner(engine, A.Select([], table, table)).query(expression(q))


def count(engine, table: str, body: dict) -> dict:
    return {"count": search(engine, table, {**body, "size": 0})["hits"]["total"]["value"]}


def document(engine, table: str, doc_id: Any) -> dict:
    pk = engine.table(table).pk[0]
    got = engine.rows(table).where(F.col(pk).cast("string") == str(doc_id)).limit(1).collect()
    return {"_id": str(doc_id), "found": bool(got), **({"_source": source(got[0])} if got else {})}


def mapping(engine, table: str) -> dict:
    kinds = {"bigint": "long", "int": "integer", "double": "double", "float": "float", "string": "text", "boolean": "boolean", "timestamp": "date"}
    return {table: {"mappings": {"properties": {c: {"type": kinds.get(k, "object")} for c, k in engine.rows(table).dtypes}}}}


def as_json(answer: dict) -> str:
    return json.dumps(answer, default=str)
