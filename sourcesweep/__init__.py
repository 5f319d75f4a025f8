"""Security and quality scans of source trees and dependencies on Spark."""

from .operators.duplicates import DuplicateOptions, duplicate_blocks
from .operators.lines import SecretOptions, SmellOptions
from .operators.structure import CsrfOptions, FunctionOptions
from .plans.report import report_lines, write_report
from .plans.scan import (Scan, code_findings, register_advisories, register_analyzer, scan)
from .rules.catalog import build_rules, catalogue_frame, custom_rule
from .session import tune
from .sources.feeds import read_feed
from .sources.files import normalise_files
from .sources.tree import open_tree, read_tree
from .streaming.feeds import arriving_documents, watch_feeds

__all__ = [
    "CsrfOptions", "DuplicateOptions", "FunctionOptions", "Scan", "SecretOptions", "SmellOptions", "arriving_documents", "build_rules", "catalogue_frame",
    "code_findings", "custom_rule", "duplicate_blocks", "normalise_files", "open_tree", "read_feed", "read_tree", "register_advisories",
    "register_analyzer", "report_lines", "scan", "tune", "watch_feeds", "write_report",
]
