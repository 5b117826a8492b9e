"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .licenses import OP4_SQL, op4_license_scan
from .mixing import op9_mix_sources
from .quality_crf import op5_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .repeats import op10_remove_repeats
from .simhash import op2_simhash
from .spotsigs import op8_spotsigs
from .url_filter import OP1_SQL, op1_url_filter
from .warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_quality_rules, op4_license_scan, op5_quality_classifier, op6_bpe, op7_warc, op8_spotsigs, op9_mix_sources, op10_remove_repeats)}

ORACLE: dict[str, str] = {"op1_url_filter": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_license_scan": OP4_SQL, "op7_warc": OP7_SQL}
