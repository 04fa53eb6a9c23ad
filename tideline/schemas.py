"""Columns of postings, the snapshot, runs and outcomes, as DDL."""

POSTING = (
    "job_uid STRING, source STRING, source_native_id STRING, title STRING, company STRING, location STRING, is_remote BOOLEAN, url STRING, description STRING, "
    "salary_min BIGINT, salary_max BIGINT, salary_currency STRING, salary_period STRING, salary_raw STRING, salary_parsed BOOLEAN, salary_bucket STRING, "
    "match_score DOUBLE, is_internship BOOLEAN, posted_at TIMESTAMP"
)
SNAPSHOT = (
    f"{POSTING}, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, last_seen_cycle BIGINT, status STRING, applied BOOLEAN, bookmarked BOOLEAN, hidden BOOLEAN, "
    "seen BOOLEAN, notes STRING, extra_context STRING, full_description STRING"
)
RUNS = (
    "run_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, trigger STRING, n_sources_ok INT, n_sources_err INT, n_new INT, n_updated INT, "
    "n_expired INT, error STRING"
)
OUTCOMES = "run_id BIGINT, source STRING, succeeded BOOLEAN, exhaustive BOOLEAN, n_fetched INT, duration_ms INT, error STRING"

POSTING_COLUMNS = [c.split()[0] for c in POSTING.split(", ")]
SNAPSHOT_COLUMNS = [c.split()[0] for c in SNAPSHOT.split(", ")]
PROVENANCE = ["source", "source_native_id", "url", "first_seen_at"]  #: kept from the first sight
USER_FLAGS = ["applied", "bookmarked", "hidden", "seen"]
USER_TEXTS = ["notes", "extra_context", "full_description"]
USER = USER_FLAGS + USER_TEXTS  #: no ingest touches these
MUTABLE = [c for c in POSTING_COLUMNS if c not in PROVENANCE and c != "job_uid"]
