"""Seconds of the six headline requests, warm medians. Prints one JSON line."""

import json
import os
import time
from statistics import median

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

PAGE = "{ orders(first: 20, filter: {oTotalprice: {greaterThan: 100000}, oOrderstatus: {equalTo: F}}) { nodes { oOrderkey oTotalprice oOrderdate } } }"
NESTED = "{ customers(first: 20, orderBy: C_ACCTBAL_DESC) { nodes { cName nationByCNationkey { nName } ordersByOCustkey(first: 5, orderBy: O_TOTALPRICE_DESC) { nodes { oOrderkey lines(first: 3) { nodes { lQuantity } } } } } } }"
COMPLEX = '{ orders(first: 20, distinct: [O_CUSTKEY], filter: {or: [{oOrderpriority: {in: ["1-URGENT", "2-HIGH"]}}, {lines: {some: {lQuantity: {greaterThan: 49}}}}], not: {oOrderstatus: {equalTo: P}}}) { totalCount nodes { oOrderkey oCustkey } } }'
CURSORS = "{ events(first: 100, orderBy: VALUE_DESC) { edges { cursor node { eventId value ts } } pageInfo { hasNextPage endCursor } } }"
AGGREGATES = "{ lineitems(filter: {lQuantity: {greaterThan: 10}}) { aggregates { sum { lExtendedprice } min { lDiscount } } } }"
GROUPED = (
    "{ lineitems { aggregates { count distinctCount { lSuppkey } sum { lQuantity lExtendedprice } average { lQuantity } stddevSample { lQuantity } varianceSample { lQuantity } min { lTax } max { lTax } } "
    "groupedAggregates(groupBy: [L_RETURNFLAG, L_LINESTATUS]) { keys count sum { lQuantity lExtendedprice } average { lDiscount } stddevSample { lQuantity } } } }"
)
REQUESTS = {"filtered_page": PAGE, "nested_page": NESTED, "filter_distinct": COMPLEX, "page_100_cursors": CURSORS, "aggregates": AGGREGATES, "grouped_aggregates": GROUPED}


def main() -> None:
    from pyspark.sql import SparkSession

    from braidlake.engine import Engine, Options
    from braidlake.sources.samples import catalog

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(catalog(spark, SF, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")), Options(timeout_s=None))
    seconds = {}
    for name, query in REQUESTS.items():
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            out = engine.graphql(query)
            took.append(time.perf_counter() - began)
            if "errors" in out:
                raise SystemExit(f"{name}: {out['errors']}")
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "headline requests, sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
