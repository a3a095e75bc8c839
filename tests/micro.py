"""Hand-made raw tables with text ids, one order per rule."""

from datetime import datetime

from martwright import schemas


def at(text):
    return datetime.fromisoformat(text) if text else None


def raw_tables(spark, **rows):
    """Raw tables from rows of plain values; tables that are not given are empty."""
    tables = {}
    for name in schemas.RAW:
        schema = schemas.raw_schema(name)
        stamps = [i for i, f in enumerate(schema) if f.dataType.simpleString() == "timestamp_ntz"]
        data = [
            tuple(at(v) if i in stamps else v for i, v in enumerate(row))
            for row in rows.get(name, [])
        ]
        tables[name] = spark.createDataFrame(data, schema)
    return tables


BOUGHT = "2018-01-01 00:00:00"
DUE = "2018-01-11 00:00:00"


def order(order_id, delivered, carrier="2018-01-04 00:00:00", customer="c1", status="delivered",
          approved="2018-01-01 12:00:00", estimated=DUE):
    return (order_id, customer, status, BOUGHT, approved, carrier, delivered, estimated)


def item(order_id, product, seller, price, freight=1.0, limit="2018-01-05 00:00:00"):
    return (order_id, product, seller, 1, price, freight, limit)
