from murmur.sources.readers import (ingest_csv, parse_csv, read_csv, read_csv_with_rejects, read_ingested, stream_sha256, read_json, read_parquet,
                                    read_manifest, file_lineage, require_path)
from murmur.sources.sinks import (write_parquet, write_parquet_counted, write_csv, write_manifest,
                                  write_jsonl, write_versioned, stage_run, commit_run, committed_runs, read_runs)
from murmur.sources.tables import table, TESTDATA_TABLES

__all__ = [
    "ingest_csv", "parse_csv", "read_ingested", "stream_sha256", "stage_run", "commit_run", "committed_runs", "read_runs",
    "read_csv", "read_csv_with_rejects", "read_json", "read_parquet", "read_manifest",
    "file_lineage", "require_path", "write_parquet", "write_parquet_counted", "write_csv",
    "write_manifest", "write_jsonl", "write_versioned", "table", "TESTDATA_TABLES",
]
