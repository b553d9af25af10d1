"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .fim import OP13_SQL, op13_fill_in_middle
from .jpeg import op4_progressive_jpeg
from .langid import op7_language_id
from .mixing import op1_mixing
from .ngram_join import op8_ngram_jaccard_join
from .packing import op10_packing
from .pii import op12_personal_data
from .quality import op9_quality
from .sharding import op6_sharding
from .topk import OP3_SQL, op3_exact_topk
from .urlfilter import OP5_SQL, op5_url_filter
from .warc import op2_warc
from .whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc, op3_exact_topk, op4_progressive_jpeg, op5_url_filter, op6_sharding, op7_language_id, op8_ngram_jaccard_join, op9_quality, op10_packing, op11_whitening, op12_personal_data, op13_fill_in_middle)}
SQL = {"op3_exact_topk": OP3_SQL, "op5_url_filter": OP5_SQL, "op13_fill_in_middle": OP13_SQL}
