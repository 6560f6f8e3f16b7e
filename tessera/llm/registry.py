"""The queries of this subpackage and their SQL."""

from .centroids import OP13_SQL, op13_centroids
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language import op4_language
from .lyndon_runs import op12_periodic_runs
from .near_dedup import op1_near_dedup
from .packing import op7_packing
from .piece_bpe import op6_sentencepiece
from .quality import OP9_SQL, op9_quality
from .repair_store import op2_token_file
from .style_tree import op10_html_text
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .wu_manber import OP11_SQL, op11_decontamination

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_file": op2_token_file,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language": op4_language,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_html_text": op10_html_text,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroids": op13_centroids,
}

SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op9_quality": OP9_SQL,
    "op11_decontamination": OP11_SQL,
    "op13_centroids": OP13_SQL,
}
