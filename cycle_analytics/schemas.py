"""Declared schemas of every input, as DDL text. CSV and JSON inputs are never inferred."""


def _ddl(text: str) -> str:
    return " ".join(text.split())


BACKUP = _ddl(
    """timestamp string, cycle_id string, chain_version string,
    pg_basebackup_s double, mongo_basebackup_s double, pg_wal_extract_s double, pg_wal_compress_s double,
    mongo_oplog_extract_s double, mongo_oplog_compress_s double, unstructured_chunk_s double,
    unstructured_delta_compress_s double, verify_s double, retention_s double, transfer_s double,
    total_cycle_s double, pg_wal_raw_bytes bigint, pg_basebackup_raw_bytes bigint,
    mongo_oplog_raw_bytes bigint, mongo_basebackup_raw_bytes bigint, unstructured_raw_bytes bigint,
    pg_wal_stored_bytes bigint, mongo_oplog_stored_bytes bigint, unstructured_stored_bytes bigint,
    cycle_total_stored_bytes bigint, wal_file_count bigint, pfc_chunk_count bigint, pg_raw_size bigint,
    pg_compressed_size bigint, mongo_raw_size bigint, mongo_compressed_size bigint, unstr_raw_size bigint,
    unstr_compressed_size bigint, cycle_raw_total_size bigint, cycle_final_transfered_size bigint,
    unstr_base_s double, unstr_base_size bigint"""
)

RESTORE = _ddl(
    """timestamp string, target_chain_version string, target_cycle_count int, verify_s double,
    unstructured_restore_s double, pg_wal_stage_s double, pg_basebackup_restore_s double,
    mongo_oplog_restore_s double, mongo_basebackup_restore_s double, total_restore_s double,
    applied_pfc_chunks bigint, verified_ok_chunks bigint, verified_fail_chunks bigint,
    wal_files_staged bigint, oplog_deltas_decompressed bigint, pg_basebackup_files_copied bigint,
    mongo_basebackup_files_copied bigint, unstructured_restored_raw_bytes bigint,
    pg_wal_restored_raw_bytes bigint, pg_basebackup_restored_raw_bytes bigint,
    mongo_oplog_restored_raw_bytes bigint, mongo_basebackup_restored_raw_bytes bigint"""
)

WORKFLOW = _ddl(
    """timestamp string, workflow_type string, chain_v string, cycle_id string, raw_size_bytes bigint,
    encrypted_size_bytes bigint, duration_aes256_sec double, duration_cloud_transfer_sec double,
    duration_vm1_transfer_sec double, total_workflow_sec double"""
)

MONITOR = _ddl(
    """timestamp string, cpu_percent double,
    memory struct<total_bytes: bigint, available_bytes: bigint, percent_used: double>,
    disk struct<total: bigint, free: bigint, used: bigint, percent: double>,
    load_average array<string>, metrics_collection_time_sec double, event string"""
)

PG_SNAPSHOT = _ddl("timestamp string, orders_total bigint, customers_total bigint, products_total bigint")
MONGO_SNAPSHOT = _ddl("timestamp string, orders_total bigint, users_total bigint, products_total bigint")
FILES_SNAPSHOT = _ddl("timestamp string, files_total bigint, bytes_total bigint")
OPERATION_LOG = _ddl("timestamp string, action string")

MANIFEST = _ddl(
    """cycle_timestamp string, chain_version string, pg_last_lsn string, mongo_last_ts string,
    pg_basebackup string, mongo_basebackup string, unstructured_basebackup string, mongo string,
    pfc struct<scanned_sizes: map<string, bigint>>, files struct<scanned_sizes: map<string, bigint>>,
    fixtures string"""
)

MANIFEST_SUMMARY = (
    "struct<chain_version: string, pg_last_lsn: string, mongo_last_ts: string, "
    "components: array<string>, unstructured_raw_bytes: bigint>"
)

CATALOG = _ddl(
    f"""alg string, chain_v string, cycle_id string, created_at string, nonce_hex string, tag_hex string,
    plaintext string, sha256_plaintext_tar string, cycle_timestamp string, manifest_summary {MANIFEST_SUMMARY}"""
)

LEDGER = _ddl("chain_v string, cycle_id string, stage string, target string, at timestamp_ntz, seconds double, reused boolean")

PACKAGE = _ddl("chain_v string, cycle_id string, rel_path string, chunk_no bigint, content binary")
