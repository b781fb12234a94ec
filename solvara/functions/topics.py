"""Weighted patterns of distress topics in news headlines."""

from __future__ import annotations

#: A weight and a regular expression on each line.
DEFAULT_AND_COVENANTS = r"""
1.0 \bdebt\s+default(?:s|ed|ing)?\b
1.0 \bdefault(?:s|ed|ing)?\s+(?:on|upon)\s+(?:debt|bonds?|loans?|notes?|interest|obligations?|credit)\b
0.95 \b(?:bond|loan|note|credit)\s+default(?:s|ed|ing)?\b
0.90 \btechnical\s+default(?:s)?\b
0.95 \bmissed\s+(?:debt\s+|interest\s+|principal\s+|coupon\s+|loan\s+)?payment(?:s)?\b
0.95 \bfailed\s+to\s+(?:make|pay|meet)\s+(?:interest|debt|loan|coupon)\s+payment(?:s)?\b
0.85 \bdistressed\s+debt\b
0.85 \bdistressed\s+exchange\b
0.85 \bdebt\s+distress(?:ed)?\b
0.75 \bdebt\s+maturity\s+wall\b
1.0 \bcovenant\s+(?:breach(?:es|ed)?|violation(?:s)?|waiver(?:s)?|default(?:s)?)\b
1.0 \bbreach(?:ed|ing)?\s+(?:of\s+)?(?:debt\s+|credit\s+|loan\s+|financial\s+)?covenant(?:s)?\b
0.95 \bviolated\s+(?:debt\s+|credit\s+|loan\s+|financial\s+)?covenant(?:s)?\b
0.95 \bcredit\s+agreement\s+(?:breach|violation|default)\b
0.90 \bforbearance\s+agreement(?:s)?\b
0.75 \bcovenant\s+relief\b
0.90 \bdebt\s+restructuring\b
0.85 \bfinancial\s+restructuring\b
0.80 \bcapital\s+structure\s+restructuring\b
0.85 \brestructure(?:s|d|ing)?\s+(?:its\s+)?(?:heavy\s+|crushing\s+)?debt\b
0.75 \brenegotiat(?:e|ing|ion)\s+(?:debt|credit\s+facility|loan\s+terms)\b
0.85 \bdebt-for-equity\s+swap(?:s)?\b
0.90 \bliquidity\s+(?:shortfall|shortage|crunch|crisis|squeeze|deficiency|concerns?|pressures?)\b
0.85 \bcash\s+crunch\b
0.75 \bcash\s+burn\s+(?:accelerates?|rapid|severe|critical)\b
0.90 \brun(?:ning)?\s+out\s+of\s+cash\b
0.90 \bcredit\s+line\s+(?:pulled|revoked|frozen|terminated|cancelled)\b
0.85 \bcredit\s+(?:rating\s+)?downgrade(?:s|d)?\b
0.95 \bdowngrade(?:s|d|ing)?\s+(?:to|deeper\s+into)\s+(?:junk|distressed|speculative|c-grade|default)\b
0.90 \brating\s+cut(?:s)?\s+to\s+junk\b
0.70 \bjunk\s+status\b
0.75 \bplaced\s+on\s+creditwatch\s+negative\b
0.80 \bcredit\s+rating\s+slashed\b
"""

#: A weight and a regular expression on each line.
BANKRUPTCY = r"""
1.0 \bchapter\s+11\b
1.0 \bchapter\s+7\b
0.90 \bchapter\s+15\b
1.0 \bpre-?packaged\s+chapter\s+11\b
1.0 \bpre-?arranged\s+bankruptcy\b
1.0 \bbankruptcy\s+protection\b
1.0 \bfile(?:s|d|ing)?\s+(?:for\s+)?bankruptcy\b
1.0 \bfiled\s+for\s+(?:chapter\s+11|chapter\s+7|bankruptcy)\b
1.0 \bbankruptcy\s+filing(?:s)?\b
0.90 \bbankruptcy\s+court\b
0.85 \bbankruptcy\s+judge\b
1.0 \bbankruptcy\s+petition\b
0.95 \bbankrupt\b
0.95 \bverge\s+of\s+bankruptcy\b
0.85 \bpossible\s+bankruptcy\b
0.90 \bweighing\s+bankruptcy\b
0.95 \bprepares?\s+for\s+bankruptcy\b
1.0 \binsolvency\s+filing(?:s)?\b
1.0 \binsolvency\s+proceeding(?:s)?\b
0.95 \binsolvent\b
0.95 \bcorporate\s+insolvency\b
0.95 \bliquidation\s+(?:plan|proceedings|sale|order)\b
0.95 \border(?:ed)?\s+liquidat(?:ed|ion)\b
0.85 \bwind-?down\s+(?:operations|business)\b
0.95 \benter(?:s|ed|ing)?\s+receivership\b
0.90 \bcourt-?appointed\s+receiver\b
0.85 \bjudicial\s+administration\b
1.0 \bdebtor-?in-?possession\b
0.95 \bdip\s+financ(?:ing|er)\b
1.0 \bgoing-?concern\s+(?:warning|doubt|uncertainty|opinion|qualification|notice)\b
1.0 \bsubstantial\s+doubt\s+about\s+(?:its\s+)?ability\s+to\s+continue\s+as\s+a\s+going\s+concern\b
0.85 \bgoing\s+concern\b
"""

#: A weight and a regular expression on each line.
LITIGATION_AND_FRAUD = r"""
1.0 \bsec\s+investigation(?:s)?\b
0.95 \bsec\s+(?:probe|inquiry|subpoena|charges?|enforcement)\b
0.95 \bdoj\s+(?:investigation|probe|inquiry|charges?|subpoena)\b
0.95 \bsecurities\s+(?:and\s+exchange\s+commission|regulator)\s+(?:probe|investigat(?:e|ion)|charges?)\b
0.95 \bgrand\s+jury\s+subpoena(?:s)?\b
0.95 \bsubpoena(?:ed|s)?\s+(?:by\s+)?(?:the\s+)?(?:sec|doj|regulators?|feds?)\b
0.95 \bformal\s+investigation\s+by\s+(?:sec|doj|authorities)\b
0.90 \bcriminal\s+(?:investigation|probe|indictment|charges?)\b
1.0 \baccounting\s+fraud\b
0.95 \baccounting\s+irregularit(?:y|ies)\b
0.95 \bfinancial\s+fraud\b
0.95 \bsecurities\s+fraud\b
0.95 \bcooking\s+the\s+books\b
1.0 \bfalsif(?:y|ied|ication)\s+of\s+financial\s+records\b
0.90 \brestatement\s+of\s+(?:financial|prior)\s+results\b
0.85 \brestat(?:e|ed|ing)\s+(?:financials|earnings|revenue|results)\b
0.80 \bdelayed\s+(?:annual\s+report|10-?k|10-?q)\s+filing\b
0.90 \bmaterial\s+weakness(?:es)?\s+in\s+internal\s+controls?\b
0.90 \bauditor\s+(?:resignation|resigned|quit|fired|withdraws?)\b
0.95 \badverse\s+audit\s+opinion\b
0.85 \bwhistleblower\s+(?:allegation|complaint|claims?|report)\b
0.85 \binternal\s+accounting\s+probe\b
0.85 \bsecurities\s+class\s+action\b
0.80 \bshareholder\s+class\s+action\s+lawsuit\b
0.65 \bclass\s+action\s+lawsuit\b
0.85 \bsued\s+for\s+(?:misleading|fraudulent|deceptive)\s+investors\b
"""


def patterns(lines: str) -> dict[str, float]:
    """Regular expressions and their weights, one on each line."""
    split = (x.partition(" ") for x in lines.strip().splitlines())
    return {pattern: float(weight) for weight, _, pattern in split}


#: Topics by name, with their weights in the composite.
DISTRESS_TOPICS = {"default_covenants": patterns(DEFAULT_AND_COVENANTS), "chapter11_bankruptcy": patterns(BANKRUPTCY), "litigation_fraud": patterns(LITIGATION_AND_FRAUD)}
TOPIC_WEIGHTS = {"chapter11_bankruptcy": 1.0, "default_covenants": 0.90, "litigation_fraud": 0.80}
