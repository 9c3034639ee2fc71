from .evolve import evolve_schema, insert_if_absent
from .ledger import RequestLedger, apply_once, commit
from .marketplace import load_marketplace, read_database
from .requests import REQUEST_SCHEMAS, load_requests, parse_requests
from .snapshot import merge_snapshot, read_keys, write_snapshot
from .text_index import TextIndex

__all__ = [
    "evolve_schema", "insert_if_absent", "load_marketplace", "read_database",
    "REQUEST_SCHEMAS", "load_requests", "parse_requests", "write_snapshot",
    "merge_snapshot", "read_keys", "TextIndex", "RequestLedger", "apply_once", "commit",
]
