"""Times headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

#: Joins, similarity, text functions, aggregation and lookups; the rest of the registry is timed by name on request.
HEADLINE = (
    "containment_match", "phrase_match_top1", "ngram_dice_top1", "ngram_dice_grid", "extract_acronyms", "event_from_title",
    "normalised_text", "html_structure", "patched_items", "vote_merge", "prefix_children", "ranked_rule_resolution", "same_time_join", "titles_of_ids", "mean_vector", "tfidf_top1", "word_trigram_jaccard", "event_pages", "series_pages",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    )
    from linkloom import queries

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        began = time.time()
        queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
