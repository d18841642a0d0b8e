"""All queries of the folder and their SQL."""

from replistat.llm import anomaly, decontam, exact, langid, mixing, negatives, pagetext, phrases, repeats, secrets, simhash, toolchat, warc

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (exact, pagetext, mixing, secrets, langid, decontam, repeats, warc, toolchat, simhash, anomaly, negatives, phrases):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
