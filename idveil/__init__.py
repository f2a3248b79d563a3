"""Find, grade and remove Indian personal identifiers in Spark tables, text and nested data."""

from idveil.functions.checksums import (
    gstin_check_digit,
    gstin_valid,
    verhoeff_check_digit,
    verhoeff_valid,
)
from idveil.functions.recognizers import (
    find_aadhaar,
    find_bank_account,
    find_gstin,
    find_ifsc,
    find_masked,
    find_mobile,
    find_pan,
    find_passport,
    find_voter_id,
)
from idveil.functions.registry import RECOGNIZERS, Registry
from idveil.functions.tokens import tokenize
from idveil.operators.remediate import changed_cells, correlate, remediate, remediate_json, sanitize
from idveil.plans.copies import PathCopies, remediate_path
from idveil.plans.scan import ScanOptions, cell_mode, scan, scan_cells, scan_rows
from idveil.plans.sources import scan_path, scan_tables
from idveil.sinks.reports import write_csv, write_json, write_summary
from idveil.sinks.sealed import decrypt_findings, encrypt_findings

__all__ = [
    "PathCopies",
    "RECOGNIZERS",
    "Registry",
    "ScanOptions",
    "cell_mode",
    "changed_cells",
    "correlate",
    "decrypt_findings",
    "encrypt_findings",
    "find_aadhaar",
    "find_bank_account",
    "find_gstin",
    "find_ifsc",
    "find_masked",
    "find_mobile",
    "find_pan",
    "find_passport",
    "find_voter_id",
    "gstin_check_digit",
    "gstin_valid",
    "remediate",
    "remediate_json",
    "remediate_path",
    "sanitize",
    "scan",
    "scan_cells",
    "scan_path",
    "scan_rows",
    "scan_tables",
    "tokenize",
    "verhoeff_check_digit",
    "verhoeff_valid",
    "write_csv",
    "write_json",
    "write_summary",
]
