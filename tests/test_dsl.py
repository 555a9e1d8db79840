"""The search DSL on a small table."""

import pytest

from larkspur.engine import Engine
from larkspur.plans import dsl


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    data = [(1, "red apple pie", "eu", 3, 1.5, 10.0, 20.0), (2, "green apple", "us", 5, 2.5, 11.0, 21.0), (3, "red wine", "eu", 7, None, -33.0, 151.0), (4, "apple apple cider", None, 1, 9.0, 48.0, 2.0)]
    df = spark.createDataFrame(data, "id long, product string, region string, units long, price double, lat double, lon double").selectExpr("id", "product", "region", "units", "price", "named_struct('lat', lat, 'lon', lon) AS loc", "array(price, units) AS emb")
    e.register("sales", df, ["id"])
    e.sql("CREATE SEARCH INDEX s ON sales (product)")
    return e


def ids(answer):
    return [int(h["_id"]) for h in answer["hits"]["hits"]]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"match": {"product": "apple"}}, {1, 2, 4}),
        ({"match_phrase": {"product": "red apple"}}, {1}),
        ({"prefix": {"product": "ci"}}, {4}),
        ({"fuzzy": {"product": {"value": "aple", "fuzziness": 1}}}, {1, 2, 4}),
        ({"term": {"region": "eu"}}, {1, 3}),
        ({"terms": {"units": [1, 5]}}, {2, 4}),
        ({"range": {"units": {"gte": 3, "lt": 7}}}, {1, 2}),
        ({"exists": {"field": "price"}}, {1, 2, 4}),
        ({"bool": {"must": [{"match": {"product": "apple"}}], "must_not": [{"term": {"region": "us"}}]}}, {1}),
        ({"bool": {"should": [{"match": {"product": "wine"}}, {"match": {"product": "cider"}}]}}, {3, 4}),
        ({"bool": {"must": {"match": {"product": "apple"}}, "should": [{"match": {"product": "pie"}}]}}, {1, 2, 4}),
        ({"geo_distance": {"distance": "300km", "loc": [20.5, 10.5]}}, {1, 2}),
        ({"geo_bounding_box": {"loc": {"top_left": [0, 60], "bottom_right": [30, 0]}}}, {1, 2, 4}),
        ({"query_string": {"query": "+apple -green"}}, {1, 4}),
        ({"match_all": {}}, {1, 2, 3, 4}),
    ],
)
def test_queries(db, query, want):
    got = dsl.search(db, "sales", {"query": query})
    assert set(ids(got)) == want and got["hits"]["total"]["value"] == len(want)


def test_boosted_order_and_paging(db):
    body = {"query": {"match_all": {}}, "sort": [{"units": "desc"}], "size": 2}
    first = dsl.search(db, "sales", body)
    assert ids(first) == [3, 2]
    assert ids(dsl.search(db, "sales", {**body, "search_after": first["hits"]["hits"][-1]["sort"]})) == [1, 4]
    assert ids(dsl.search(db, "sales", {**body, "from": 1})) == [2, 1]


def test_aggregations(db):
    got = dsl.search(db, "sales", {"size": 0, "aggs": {
        "by": {"terms": {"field": "region"}, "aggs": {"u": {"sum": {"field": "units"}}, "top": {"top_hits": {"size": 1, "sort": [{"units": "desc"}]}}}},
        "p": {"percentiles": {"field": "units", "percents": [50]}}, "c": {"cardinality": {"field": "region"}},
        "m": {"composite": {"size": 2, "sources": [{"r": {"terms": {"field": "region"}}}]}},
    }})["aggregations"]
    assert [(b["key"], b["doc_count"], b["u"]["value"]) for b in got["by"]["buckets"]] == [("eu", 2, 10), ("us", 1, 5)]
    assert got["by"]["buckets"][0]["top"]["hits"]["hits"][0]["_source"]["id"] == 3
    assert got["p"]["values"] == {"50.0": 4.0} and got["c"]["value"] == 2
    assert [b["key"]["r"] for b in got["m"]["buckets"]] == [None, "eu"] and got["m"]["after_key"] == {"r": "eu"}


def test_highlight_knn_and_retrievers(db):
    got = dsl.search(db, "sales", {"query": {"match": {"product": "wine"}}, "highlight": {"fields": {"product": {}}}})
    assert got["hits"]["hits"][0]["highlight"]["product"] == ["red <b>wine</b>"]
    near = dsl.search(db, "sales", {"knn": {"field": "emb", "query_vector": [9.0, 1.0], "k": 1}})
    assert ids(near) == [4]
    both = {"rrf": {"retrievers": [{"standard": {"query": {"match": {"product": "cider"}}}}, {"knn": {"field": "emb", "query_vector": [9.0, 1.0]}}]}}
    assert ids(dsl.search(db, "sales", {"retriever": both}))[0] == 4
    ranked = {"text_similarity_reranker": {"retriever": both, "field": "product", "inference_text": "green"}}
    assert ids(dsl.search(db, "sales", {"retriever": ranked}))[0] == 2


def test_count_doc_mapping_and_errors(db):
    assert dsl.count(db, "sales", {"query": {"term": {"region": "eu"}}}) == {"count": 2}
    assert dsl.document(db, "sales", 2)["_source"]["product"] == "green apple"
    assert dsl.mapping(db, "sales")["sales"]["mappings"]["properties"]["units"] == {"type": "long"}
    for bad in ({"nope": {}}, {"bool": {"filter": [{"term": {"region": "eu"}}], "should": [{"match": {"product": "x"}}]}}):
        with pytest.raises(ValueError):
            dsl.search(db, "sales", {"query": bad})


def test_buckets_are_bounded(db, monkeypatch):
    body = {"size": 0, "aggs": {"by": {"terms": {"field": "region", "size": 10}}}}
    assert len(dsl.search(db, "sales", body)["aggregations"]["by"]["buckets"]) >= 2
    monkeypatch.setattr(dsl, "MAX_BUCKETS", 1)
    with pytest.raises(ValueError):
        dsl.search(db, "sales", body)
