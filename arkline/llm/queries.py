"""The training-data queries, by name, and the SQL of those that SQL can express."""

from . import covertree, decontam, jaccard, pieces, quotes, secrets, toxicity, urlrules, warc, wrappers

QUERIES = {
    "op1_warc": warc.op1,
    "op2_top_k": covertree.op2,
    "op3_decontamination": decontam.op3,
    "op4_jaccard_join": jaccard.op4,
    "op5_html_text": wrappers.op5,
    "op6_secret_scan": secrets.op6,
    "op7_sentencepiece": pieces.op7,
    "op8_chat_format": quotes.op8,
    "op9_url_filter": urlrules.op9,
    "op10_toxicity": toxicity.op10,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE,
    "op2_top_k": covertree.ORACLE,
    "op3_decontamination": decontam.ORACLE,
    "op4_jaccard_join": jaccard.ORACLE,
    "op5_html_text": wrappers.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op9_url_filter": urlrules.ORACLE,
}
