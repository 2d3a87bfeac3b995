"""Table schemas as DDL."""

EVENT = (
    "qid STRING, label STRING, title STRING, acronym STRING, dblp_id STRING, ordinal INT, part_of_series STRING, start_time TIMESTAMP, end_time TIMESTAMP, "
    "country STRING, location STRING, official_website STRING, colocated_with STRING, wikicfp_id STRING, type STRING, ceurws_url STRING, described_at_url STRING"
)
SERIES = "qid STRING, label STRING, title STRING, acronym STRING, dblp_id STRING, official_website STRING, wikicfp_id STRING, instance_of ARRAY<STRING>, type STRING"
PROCEEDING = (
    "qid STRING, label STRING, event STRING, volume_number INT, title STRING, ceurws_title STRING, pub_date TIMESTAMP, ceurws_url STRING, described_at_url STRING, acronym STRING, dblp_id STRING"
)
COMPLETION = "qid STRING, attr STRING, value STRING, found_by STRING, seq BIGINT"
MATCH = "event_qid STRING, series_kind STRING, series_qid STRING, series_dblp_id STRING, series_name STRING, found_by STRING, score DOUBLE, seq BIGINT"
