"""A refresh replaces the marts as one set, or not at all."""

import pytest
from martwright.operators import marts as build
from martwright.plans import refresh
from martwright.sources import versions
from martwright.sources.star_schema import read_star_schema


def stored_versions(folder):
    return {p.name for p in (folder / "versions").iterdir()}


@pytest.fixture(scope="module")
def raw(spark, small):
    return read_star_schema(spark, small)


def halved(raw):
    return raw | {"raw_orders": raw["raw_orders"].where("crc32(cast(order_id AS string)) % 2 = 0")}


def test_a_refresh_that_dies_between_marts_leaves_the_old_set(spark, raw, tmp_path, monkeypatch):
    folder = str(tmp_path)
    built = refresh.refresh_marts(raw, folder)
    first = versions.current_version(spark, folder)
    before = refresh.read_marts(spark, folder, raw)

    def dies(*_):
        raise RuntimeError("lost")

    for name in ("build_order_seller", "build_seller_mart"):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
            patch.setattr(build, name, dies)
            refresh.refresh_marts(halved(raw), folder)
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
        patch.setattr(versions, "publish", dies)
        refresh.refresh_marts(halved(raw), folder)
    assert versions.current_version(spark, folder) == first and len(stored_versions(tmp_path)) == 4
    read = refresh.read_marts(spark, folder, raw)
    assert read.rows == built.rows
    assert {n: getattr(read, n).count() for n in ("orders", "order_seller", "sellers")} == {
        "orders": built.rows["orders_mart"], "order_seller": built.rows["order_seller"],
        "sellers": built.rows["seller_mart"],
    }
    # who began to read before goes on through the next whole refresh, which drops what died
    after = refresh.refresh_marts(halved(raw), folder)
    assert before.orders.count() == built.rows["orders_mart"] > after.rows["orders_mart"]
    assert refresh.read_marts(spark, folder, raw).orders.count() == after.rows["orders_mart"]
    second = versions.current_version(spark, folder)
    assert second.before == (first.name,) and stored_versions(tmp_path) == {first.name, second.name}


def test_superseded_versions_go(spark, raw, tmp_path):
    folder = str(tmp_path)
    assert versions.current_version(spark, folder) is None
    assert versions.remove_superseded(spark, folder) == []
    names = []
    for i in range(4):
        version = versions.new_version()
        spark.range(i).write.parquet(f"{version.path(folder)}/orders_mart")
        names.append(versions.publish(spark, folder, version, {"orders_mart": i}).name)
        versions.remove_superseded(spark, folder, kept=2)
        assert versions.current_version(spark, folder).rows == {"orders_mart": i}
        assert stored_versions(tmp_path) == set(names[-3:])
    assert versions.remove_superseded(spark, folder, kept=0) == sorted(names[:-1][-2:])
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("_")] == [versions.POINTER]


def test_repeated_keys_write_nothing(spark, raw, tmp_path):
    twice = raw | {"raw_orders": raw["raw_orders"].union(raw["raw_orders"])}
    with pytest.raises(ValueError, match="more than once"):
        refresh.refresh_marts(twice, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_marts_are_built_once(spark, raw, tmp_path):
    first = refresh.ready_marts(spark, str(tmp_path), raw)
    again = refresh.ready_marts(spark, str(tmp_path), raw)
    assert again.rows == first.rows and len(stored_versions(tmp_path)) == 1
