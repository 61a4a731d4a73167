from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.plans import bronze
from shelfline.sources import events, tables
from shelfline.sources.catalog import read_catalog, split_catalog

CATALOG = {
    "hosen": [
        {"id": "h-1", "name": "Jeans", "brand": "B", "price": 129.0, "originalPrice": 249.0, "color": "Blau",
         "image": "j.jpg", "sizes": ["26/32", "27/32"]},
        {"id": "h-2", "name": "Hose", "brand": "B", "price": 124.0, "originalPrice": None, "color": "Beige",
         "image": "h.jpg", "sizes": []},
    ],
    "roecke": [{"id": "r-1", "name": "Rock", "price": 50.0, "originalPrice": 50.0}],
    "mützen": [],
    "schals": [{"id": "s-1", "name": "Schal", "price": 10.0}],
}


def test_catalog_over_many_lines(spark, tmp_path, rows):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CATALOG, indent=2, ensure_ascii=False), encoding="utf-8")
    got = {r.product_id: r for r in read_catalog(spark, str(path)).collect()}
    assert set(got) == {"h-1", "h-2", "r-1", "s-1"}
    assert (got["h-1"].discount, got["h-1"].category_name, got["h-1"].sizes) == (48, "Hosen", ["26/32", "27/32"])
    assert got["h-2"].discount is None and got["r-1"].discount is None
    assert got["r-1"].category_name == "Röcke" and got["s-1"].category_name == "Schals"


def test_catalog_with_a_document_per_line(spark, tmp_path):
    path = tmp_path / "catalog.jsonl"
    path.write_text("\n".join(json.dumps({k: v}) for k, v in CATALOG.items()) + "\nnot json\n", encoding="utf-8")
    assert read_catalog(spark, str(path), whole_file=False).count() == 4


@pytest.mark.parametrize("block", [1, 2, 100])
def test_variants_are_numbered_in_catalog_order(spark, block):
    titles = [
        (1, "jackets", 0, "Boss Jacke", "Wolle", 10.0, ["rot", "blau"]),
        (1, "jackets", 1, "Hugo Mantel", "Wolle", 20.0, []),
        (1, "jackets", 2, "Boss Mantel", "Wolle", 30.0, ["grau"]),
        (2, "shoes", 0, "Hugo Schuh", "Leder", 40.0, ["schwarz", "weiss", "braun"]),
        (2, "shoes", 5, "Boss Schuh", "Leder", 50.0, None),
        (2, "shoes", 7, "Boss Stiefel", "Leder", 60.0, ["braun"]),
    ]
    catalog = spark.createDataFrame(
        titles, "category_no int, category string, title_no int, title string, material string, price double, colors array<string>")
    built = bronze.variants(catalog, block=block)
    got = [(r.product_id, r.name, r.color, r.brand) for r in bronze.products(built).orderBy("product_id").collect()]
    assert got == [
        ("P0001", "Boss Jacke", "rot", "BOSS"), ("P0002", "Boss Jacke", "blau", "BOSS"), ("P0003", "Boss Mantel", "grau", "BOSS"),
        ("P0004", "Hugo Schuh", "schwarz", "HUGO"), ("P0005", "Hugo Schuh", "weiss", "HUGO"),
        ("P0006", "Hugo Schuh", "braun", "HUGO"), ("P0007", "Boss Stiefel", "braun", "BOSS"),
    ]
    assert bronze.product_categories(built).where("category = 'shoes'").count() == 4


def test_inventory_grid_fills_with_zero(spark):
    cats = spark.createDataFrame([("P1", "jackets"), ("P2", "shoes"), ("P3", "hats")], schemas.PRODUCT_CATEGORIES)
    stock = spark.createDataFrame([("P1", "Cologne", "S", 2), ("P1", "Cologne", "S", 3)], schemas.PRODUCT_INVENTORY)
    grid = bronze.inventory_grid(cats, stock)
    assert grid.count() == 5 * 5 + 8 * 5
    assert grid.where("amount > 0").select("product_id", "location", "size", "amount").collect() == [("P1", "Cologne", "S", 5)]


def test_with_schema_casts_fills_and_orders(spark):
    df = spark.createDataFrame([("7.5", "x", "P1", "N"), (None, "y", "P2", "M")], "base_price string, extra string, product_id string, name string")
    out = tables.with_schema(df, schemas.PRODUCTS)
    assert out.columns == ["product_id", "name", "material", "base_price", "color", "brand"]
    assert [tuple(r) for r in out.orderBy("product_id").collect()] == [("P1", "N", None, 7.5, None, None), ("P2", "M", None, None, None, None)]


@pytest.mark.parametrize("bad", [("P1", "L", "S", "x7"), (None, "L", "S", "7"), ("P1", "L", "S", None)])
def test_rows_that_break_their_schema_stop_the_job_or_are_set_aside(spark, bad):
    df = spark.createDataFrame([("P0", "L", "S", "3"), bad], "product_id string, location string, size string, amount string")
    with pytest.raises(Exception, match="takes no such value"):
        tables.with_schema(df, schemas.PRODUCT_INVENTORY).collect()
    good, rejects = tables.split_by_schema(df, schemas.PRODUCT_INVENTORY)
    assert [tuple(r) for r in good.collect()] == [("P0", "L", "S", 3)]
    assert rejects.count() == 1 and rejects.first().reason.startswith("amount" if bad[0] else "product_id")


def test_tables(spark, rows):
    ns = "t_tables"
    tables.reset_layer(spark, ns, ["numbers"])
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for _ in range(2):
        tables.write_table(df, ns, "numbers")
    assert rows(tables.read_table(spark, ns, "numbers")) == [(1, "a"), (2, "b")]
    tables.write_table(df.select("s"), ns, "numbers", partition_by=[])
    assert tables.read_table(spark, ns, "numbers").columns == ["s"]
    assert [r.s for r in tables.preview(tables.read_table(spark, ns, "numbers"), ["s"], 1).collect()] == ["a"]
    tables.reset_layer(spark, ns, ["numbers"])
    assert not spark.catalog.tableExists(f"{ns}.numbers")
    assert tables.empty_like(spark, "a int, b string").count() == 0


def test_pack_and_publish_round_trip(spark, rows, tmp_path):
    items = spark.createDataFrame(
        [("o1", 1, "p2", 5.0), ("o1", 0, "p9", 1.5), ("o2", 0, "p1", 2.0)], "order_id string, n int, product_id string, price double")
    packed = events.pack_items(items, "order_id", ["n"], {"product_id": F.col("product_id"), "price": F.col("price")})
    messages = events.to_events(packed, "order_id")
    assert {r.key for r in messages.collect()} == {"o1", "o2"}
    folder = str(tmp_path / "messages")
    events.publish(messages, folder)
    back = events.parse_events(spark.read.text(folder), schemas.SALE_EVENT)
    got = {r.order_id: [(i.product_id, i.price) for i in r["items"]] for r in back.collect()}
    assert got == {"o1": [("p9", 1.5), ("p2", 5.0)], "o2": [("p1", 2.0)]}


def test_parse_drops_broken_lines_and_keeps_partly_readable_ones(spark):
    lines = ['{"order_id": "a", "discount": 12.5}', "{broken", "", '{"order_id": "b", "total_price": "much"}', "[]"]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.order_id: (r.discount, r.total_price) for r in events.parse_events(raw, schemas.SALE_EVENT).collect()}
    assert got == {"a": (12.5, None), "b": (None, None)}


def test_an_object_as_product_id_stays_as_json(spark):
    raw = spark.createDataFrame([('{"order_id": "a", "items": [{"product_id": {"v": 1}}, {"product_id": "p"}]}',)], "value string")
    items = events.parse_events(raw, schemas.SALE_EVENT).first()["items"]
    assert [i.product_id for i in items] == ['{"v":1}', "p"]


def test_a_cluster_needs_a_shared_scratch_folder():
    from types import SimpleNamespace

    from shelfline.session import scratch_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="a"))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(session(master), "x")
        assert scratch_dir(session(master, "hdfs://shared"), "x").startswith("hdfs://shared/x-")
    assert scratch_dir(session("local[4]"), "x")


LISTED = {
    "hosen": [{"id": "p1", "name": "a } b", "price": 5.0, "sizes": ["S", "{"]}, {"id": "p2", "name": 'say "x" \\', "price": 7.5}],
    "leer": [],
    'st"range {name}': [{"id": f"q{i}", "name": "n" * (i % 7), "price": float(i)} for i in range(300)],
}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", ["1k", "128m"])
def test_a_large_catalog_is_split_whatever_its_layout(spark, rows, tmp_path, indent, block):
    documents = [LISTED, {"jacken": [{"id": "z1", "extra": {"deep": {"er": 1}}, "name": "n"}]}, {}]
    for n, name in enumerate(("a.json", "b.json")):
        text = "\n".join(json.dumps(d, indent=indent) for d in documents)
        (tmp_path / name).write_text(text.replace("z1", f"z{n}"), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = split_catalog(spark, str(tmp_path))
        got = rows(found.select("category_id", "product.id", "product.name", "product.price", F.array_join("product.sizes", "")))
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(c, p["id"].replace("z1", f"z{n}"), p.get("name"), p.get("price"), "".join(p["sizes"]) if "sizes" in p else None)
            for n in range(2) for d in documents for c, of in d.items() for p in of]
    assert got == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert tasks > 4 if block == "1k" else tasks <= 2


def test_fields_that_do_not_fit_are_named(spark, rows):
    good = ['{"order_id": "a", "total_price": 5, "items": [{"price": 1.5}, null]}', '{"order_id": "b", "total_price": null}', '{"order_id": 7}',
            '{"order_id": "o", "user": {"id": 1}}', '{"order_id": "c", "more": {"x": [1]}}', '{"order_id": "d", "items": []}']
    bad = {
        '{"order_id": "a", "total_price": "abc"}': "total_price does not fit",
        '{"order_id": "a", "total_price": "abc", "discount": true}': "discount does not fit",
        '{"order_id": "b", "is_community_created": "perhaps"}': "is_community_created does not fit",
        '{"order_id": "c", "items": [{"price": 1}, {"price": 2, "quantity": 1.5}]}': "items[].quantity does not fit",
        '{"order_id": "d", "items": 5}': "items does not fit",
        '{"order_id": "e", "items": [{"price": 1}, 7]}': "items does not fit",
        '{"total_price": "abc"}': "total_price does not fit",
        '{"order_id": "f"': "no JSON", "": "no JSON", '{"x": 1}': "no known field",
        '{"order_id": "g", "event_time": "soon"}': "unreadable time",
    }
    raw = spark.createDataFrame([(x,) for x in [*good, *bad]], "value string")
    judged = events.judge_messages(raw, schemas.SALE_EVENT)
    assert {r.value: r.reason for r in judged.collect()} == {**dict.fromkeys(good), **bad}
    assert judged.schema["event"].dataType == schemas.SALE_EVENT


def test_a_message_is_parsed_once(spark):
    """A filter on the reason must not be moved below the parser, where it parses once for each field it reads."""
    raw = spark.createDataFrame([('{"order_id": "a"}',), ('{"order_id"',), ('{"total_price": "abc"}',)], "value string")
    taken = events.parse_events(raw, schemas.SALE_EVENT)
    plain = events.judge_messages(raw, schemas.SALE_EVENT).where("reason IS NULL").select("event.*")
    for df, n_rows in ((taken, 2), (plain, 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        assert df.count() == n_rows
