"""Vocabularies, cue patterns and limits that results depend on.

They are configuration; operators take them as defaults of their parameters.
"""

from __future__ import annotations

# ---- fixed values: verbs that make a claim ----
CLAIM_VERBS = ["argue", "suggest", "define", "distinguish", "conclude", "claim", "maintain", "propose", "contend", "demonstrate", "show", "assert"]
CLAIM_ENDINGS = ["s", "es", "ed", "ing", "d"]
KO_STEMS = ["주장", "제안", "정의", "구분", "구별", "지적", "논증", "강조", "제시"]
KO_ENDINGS = ["한다", "하며", "하고", "했다", "하였다", "하는", "하기", "함"]
KO_WHOLE = ["결론짓는다", "결론지었다", "결론내린다", "결론내렸다"]

CLAIM_EN = rf"(?i)\b(?:{'|'.join(CLAIM_VERBS)})(?:{'|'.join(CLAIM_ENDINGS)})?\b"
CLAIM_KO = rf"(?:{'|'.join(KO_STEMS)})(?:{'|'.join(KO_ENDINGS)})|{'|'.join(KO_WHOLE)}"
#: Verb forms that claim nothing: each match takes one from the count.
CLAIM_GUARDS = [
    r"(?i)\b(?:shows?|showed|showing)\s+up\b",
    r"(?i)\b(?:the|a|an|this|that|these|those|no)\s+claims?\b",
    r"(?i)-\s*defined\b",
    r"(?i)\b(?:the|a|an|this|that|these|those)\s+proposed\b",
]

# ---- fixed values: structural noise, in order ----
DEMOTIONS = {
    "footnote": [r"(?i)(?:\A|\n)\s*\[?\d{1,3}\]?[.)]\s+.{0,40}(?:p\.|pp\.|쪽|면|참조|cf\.|ibid|op\. cit)"],
    "bibliography": [
        r"(?i)(?:참고\s*문헌|인용\s*문헌|references|bibliography|works\s+cited)",
        r"[A-Z][a-z]+,\s+[A-Z]\.?(?:\s*[A-Z]\.?)*\s*\(\d{4}\)",
        r"(?:see|cf\.|참조)\s+[A-Z][A-Za-z.'-]+|[A-Z][A-Za-z.'-]+,\s+[“\x22][^”\x22]{4,}[”\x22],?\s*\d{1,4}|[“\x22][^”\x22]{4,}[”\x22],?\s*\d{1,4}\s*[-–]\s*\d{1,4}",
    ],
    "table_of_contents": [r"(?i)(?:목\s*차|table\s+of\s+contents|차\s*례)", r"\.{4,}\s*\d{1,4}\s*(?:\n|\z)"],
    "index": [r"(?i)(?:색\s*인|찾아보기)|(?:\A|\n)\s*(?i:index)\s*(?:\n|\z)", r"\S,\s+\d{1,4}(?:,\s*\d{1,4}){2,}"],
    "copyright": [r"(?i)(?:판\s*권|저작권|copyright|©|all\s+rights\s+reserved|ISBN[\s:]*[\d-]{10,})"],
}
CITATION = DEMOTIONS["bibliography"][2]

# ---- fixed values: cues of prose types ----
METHOD_CUE = r"(?i)\b(?:method|methodology|approach|framework|analysis|criteria|principle|procedure|model|compare|comparison)\b|(?:방법론?|접근|분석|기준|원리|절차|모형|비교)"
OBJECTION_CUE = r"(?i)\b(?:however|nevertheless|despite|although|against|rejects?|challenges?|criticizes?|disputes?|doubt|problem|limitation)\b|(?:그러나|하지만|반면|그럼에도|비판|반론|반박|거부|의문|한계|문제)"
ARGUMENT_CUE = r"(?i)\b(?:because|therefore|thus|as a result|observes?|indicates?|emphasizes?)\b|(?:따라서|그러므로|때문|결과|보인다|시사|강조)"
ARGUMENT_AGENT = r"(?i)\b(?:the\s+)?(?:author|authors|chapter|article|paper|study|text|analysis|scholar)\s+(?:argues?|claims?|maintains?|contends?|asserts?|concludes?|suggests?|demonstrates?|shows?)\b|(?:저자|필자|이\s*장|이\s*논문|본문)\s*(?:은|는|이|가)?\s*(?:주장|제안|지적|논증|강조|결론)"
BOUNDARY_CUE = r"(?i)\b(?:not by itself|does not prove|cannot establish|requires?|must not|should not|do not|without|rather than|not as)\b|(?:만으로는|증명하지|입증하지|아니다|요구|필요|한계|경계|검증)"
BOUNDARY_SCORE_CUE = r"(?i)\b(?:not by itself|does not prove|cannot establish|requires?|must not|should not|do not|without|rather than|not as)\b|(?:만으로는|증명하지|입증하지|요구|필요|한계|경계|검증)"
METHOD_AGENT = r"(?i)\b(?:this|the)\s+(?:method|approach|framework|analysis)\s+(?:compares?|uses?|analyzes?|examines?|distinguishes?|tests?)\b|(?:이\s*)?(?:방법|접근|분석)\s*(?:은|는|이|가)?\s*(?:비교|분석|검토|구분)"
SENTENCE_END = r"[.!?。！？][\x22”’'\)\]]?\s*\z"

# ---- fixed values: definitions and quotations ----
CONCEPT_LINE = r"(?i)\A\s*Concept\s*:\s*([^\n]{3,})\z"
KO_DEFINITION = r"\A([^\n]{1,40}?)(?:은|는)\s+([^\n]{6,}?)(?:이다|입니다)\.?\s*\z"
DEFINED_AS = r"(?i)\A\s*([^\n]{2,80}?)\s+(?:is|are)\s+(?:defined|understood|known)\s+as\s+([^\n]{8,240})[.!?]?\s*\z"
REFERS_TO = r"(?i)\A\s*([^\n]{2,80}?)\s+(?:refers to|denotes|means|signifies|describes)\s+([^\n]{8,240})[.!?]?\s*\z"
IS_A = r"(?i)\A\s*([^\n]{2,80}?)\s+(?:is|are)\s+((?:a|an|the)\s+[^\n]{8,240})[.!?]?\s*\z"
SUBJECT_STOP = r"(?i)\A(?:the|this|that|these|those)\s+(?:author|authors|chapter|book|article|paper|study|section|paragraph|line|text|example|table|figure|appendix)\b"
SUBJECT_VERB = r"(?i)\b(?:is|are|was|were|be|been|being|has|have|had|do|does|did|can|could|should|would|may|might|must|argues?|claims?|shows?|suggests?|states?)\b"
PREDICATE_NOUN = r"(?i)\b(?:account|approach|category|condition|construct|criterion|doctrine|effect|exchange|factor|framework|function|genre|indicator|instrument|method|model|norm|pattern|phenomenon|principle|procedure|process|protocol|relationship|rule|sense|standard|strategy|system|technique|term|theory|variable)\b"
QUOTES = [r"\x22([^\x22\n]{32,})\x22", r"“([^”\n]{32,})”", r"「([^」\n]{12,})」"]

# ---- fixed values: words that tokens leave out ----
STOP_WORDS = "the a an and or of to in on as is are for with by at be this that it its from 그리고 또는 그 이 저 것 수 등 및 에 의".split()

# ---- fixed values: terms kept in their original form ----
METHOD_TERMS = [
    "figural interpretation", "gospel-shaped hermeneutic", "inverted allusion", "intertextuality", "intertextual", "metalepsis", "metaleptic", "leitwortstil", "leitwort",
    "narrative poetics", "reading backwards", "rhetorical situation", "socio-rhetorical", "inner texture", "intertexture", "ideological texture", "translation technique",
    "textual criticism", "sensus plenior", "ad hoc", "a priori", "a posteriori", "Sitz im Leben", "typology", "Old Greek", "Septuagint", "Masoretic Text",
]
NOISY_ABBREVIATIONS = "API CSS EU FAQ HTML HTTP ISBN JSON LLM NASA OCR PDF SQL UK UN URL USA XML".split()
NOISY_HYPHENS = "well-known well-defined mother-in-law father-in-law brother-in-law sister-in-law".split()
HYPHEN_PARTS = "biblical critical criticism exilic form gospel historical inner inter literary redaction rhetorical second shaped socio source temple text textual theological".split()
GREEK = r"\p{Greek}[\p{Greek}\p{M}·'’-]+"
HEBREW = r"\p{Hebrew}[\p{Hebrew}\p{M}־-]+"
ABBREVIATION = r"\b(?:[A-Z]{2,8}[0-9]{0,2}|[A-Z]{1,4}[0-9]{2,4})\b"
HYPHEN_TERM = r"\b[A-Za-z][A-Za-z]+(?:-[A-Za-z]+){1,3}\b"

# ---- fixed values: sections and names ----
SECTION_MARKER = r"(?i)\A\s*(?:(?:chapter|chap\.?|part|section|appendix)\s+[\divxlcdm]+|postscript\b|introduction\b|conclusion\b|\d+(?:\.\d+)*[.)]?\s+\S|제\s*\d+\s*(?:장|절|부|편))"
CAPS_NAMES = r"\A\s*[A-Z][A-Z.'-]+(?:\s+[A-Z][A-Z.'-]+){1,5}\s*\z"
PERSON_STOP_WORDS = "and of the in on for with land death bible biblical hebrew".split()
NAME_PARTICLES = "de del der la le van von".split()
CONCEPT_WORDS = (
    "apocalypse canon christology church covenant criticism deuteronomistic divine ecclesiology eschatology exile form gospel holy kingship law literature mount narrative "
    "priestly prophecy redaction ritual sacrifice scripture sinai source spirit temple theology tradition wisdom"
).split()

# ---- fixed values: limits ----
SHORT_PROSE, PROSE, LONG_PROSE = 35, 80, 900
CHUNK_CHARS, BATCH_CHUNKS, EVIDENCE_CHARS, CONTEXT_LINE = 1800, 8, 900, 260
QUOTE_CHARS, MAX_TERMS, MAX_REFS, TOP_CARDS, CARD_CHUNKS = 600, 12, 12, 8, 4

# ---- fixed values: bibliographic lines ----
BIB_CHARS, BIB_LINES, BIB_TITLE_LINES, BIB_FIELD, BIB_TITLE, BIB_DISPLAY = 16_000, 90, 40, 120, 150, 220
BIB_NOISE = [
    r"\A\d{1,4}\z",
    r"\A[-–—_*=\s]+\z",
    r"(?i)\bisbn\b|copyright|all rights reserved|printed in|published by|table of contents|contents\b",
    r"(?i)\A(?:목\s*차|차례|참고문헌|색인|bibliography|references|index)\z",
    r"(?i)\A(?:chapter|part|section)\s+\d+",
    r"(?i)\Apage\s+\d+",
]
BIB_NOT_TITLE = [r"(?i)\A(?:by|edited by|translated by)\b", r"\A(?:저자|지은이|글|옮긴이|역자|번역|출판사?)\s*[:：]"]
BIB_AUTHOR_KO = r"(?:저자|지은이|글)\s*[:：]\s*([^\n]+)\z"
BIB_AUTHOR = r"(?i)\bby\s+([^\n]+)\z"
BIB_AUTHOR_DROPS = [r"(?i)\btranslated by\b[^\n]+\z", r"(?i)\bedited by\b[^\n]+\z"]
BIB_TRANSLATOR_KO = r"(?:옮긴이|역자|번역)\s*[:：]\s*([^\n]+)\z"
BIB_TRANSLATOR = r"(?i)\btranslated by\s+([^\n]+)\z"
BIB_PUBLISHER_KO = r"(?:출판사|출판|펴낸곳)\s*[:：]\s*([^\n]+)\z"
BIB_PUBLISHER = r"(?i)\b(?:press|publishing|publisher|books|verlag|academic|university)\b|(?:출판|출판부|출판사|대학교출판)"
BIB_YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
BIB_TRIM = r"\A[,.:;|\-–—\s]+|[,.:;|\-–—\s]+\z"

# ---- fixed values: orders of decisions and actions ----
DECISIONS = ("approved", "pending", "held", "discarded")
ACTIONS = ("create_new", "update_existing", "link_only", "ignore")

# ---- fixed values: one-hop synonyms of a token ----
SYNONYMS = {
    "typology": "모형론, 예표론",
    "hermeneutic": "해석학, hermeneutics",
    "hermeneutics": "해석학, hermeneutic",
    "allusion": "암시, 인유",
    "intertextuality": "상호텍스트성, intertextual",
    "intertextual": "상호텍스트성, intertextuality",
    "exile": "유배, 포로",
    "covenant": "계약, 언약",
    "kingdom": "나라, 왕국",
    "passion": "수난",
    "psalm": "시편",
    "paul": "바오로, pauline",
    "pauline": "paul, 바오로",
    "parrhesia": "παρρησία, παρρησια, 파레시아, boldness, frankness, free speech",
    "παρρησία": "parrhesia, παρρησια, 파레시아, boldness, frankness, free speech",
    "παρρησια": "parrhesia, παρρησία, 파레시아, boldness, frankness, free speech",
    "boldness": "parrhesia, παρρησία, 파레시아, 담대함",
    "frankness": "parrhesia, παρρησία, 파레시아, 솔직함",
    "cor": "corinthians, 코린, 코린토, 고린토, 고린, 1코린, 2코린",
    "corinthians": "cor, 코린, 코린토, 고린토, 고린, 1코린, 2코린",
    "gal": "galatians, 갈라, 갈라티아",
    "galatians": "gal, 갈라, 갈라티아",
    "acts": "사도, 사도행전",
    "heb": "hebrews, 히브, 히브리",
    "hebrews": "heb, 히브, 히브리",
    "john": "요한",
    "mark": "마르, 마르코",
    "해석학": "hermeneutic, hermeneutics",
    "모형론": "typology",
    "예표론": "typology",
    "상호텍스트성": "intertextuality, intertextual",
    "유배": "exile",
    "계약": "covenant",
    "언약": "covenant",
    "수난": "passion",
    "시편": "psalm",
    "바오로": "paul, pauline",
    "파레시아": "parrhesia, παρρησία, παρρησια, boldness, frankness, free speech",
    "담대함": "boldness, parrhesia, παρρησία",
    "솔직함": "frankness, parrhesia, παρρησία",
    "코린": "cor, corinthians, 1코린, 2코린",
    "코린토": "cor, corinthians, 고린토, 1코린, 2코린",
    "고린토": "cor, corinthians, 코린토, 1코린, 2코린",
    "고린": "cor, corinthians, 코린, 1코린, 2코린",
    "1코린": "cor, corinthians, 코린, 코린토, 고린토, 고린",
    "2코린": "cor, corinthians, 코린, 코린토, 고린토, 고린",
    "갈라": "gal, galatians, 갈라티아",
    "갈라티아": "gal, galatians, 갈라",
    "사도": "acts, 사도행전",
    "사도행전": "acts, 사도",
    "히브": "heb, hebrews, 히브리",
    "히브리": "heb, hebrews, 히브",
    "요한": "john",
    "마르": "mark, 마르코",
    "마르코": "mark, 마르",
}

# ---- fixed values: titles and Markdown forms ----
SENTENCE_HEAD = r"\A[^\n]{40,140}?[.!?](?:\s|\z)"
TITLE_DROPS = [
    r"[.!?]\s*\z",
    r"(?i)\A(?:however|nevertheless|therefore|thus),?\s+",
    r"(?i)\A(?:the author|the chapter|this chapter|this study|the text)\s+(?:argues?|suggests?|observes?|indicates?|maintains?|claims?|contends?|demonstrates?|shows?|challenges?|criticizes?)\s+(?:that\s+)?",
    r"(?i)\A(?:저자는?|이\s*장(?:은|에서는)?)\s*(?:주장|제안|지적|강조|논증|비판|반박)(?:한다|하며|했다|하였다|하는)?\s*",
]
CONCEPT_HEADING = r"(?i)\A(?:Concept|Definition|개념|정의)(?![A-Za-z0-9_])"
BOLD_DEFINITION = r"\*\*([^*\n]+)\*\*\s*[—–-]\s*([^\n]{8,})"
BOLD_SENTENCE = r"\A(.{8,260}?[.!?])\s+(.{40,})\z"

# ---- fixed values: thresholds of matching and scoring ----
SIM_UPDATE, SIM_LINK, IGNORE_TOTAL, OUTLINE_LEAST = 0.5, 0.2, 1, 0.18

# ---- fixed values: the Markdown form of entries ----
MD_KEYS = ("id", "title", "category", "status", "outline_node_id", "source_ids", "original_terms", "tags", "related", "created_from_candidates", "created_at", "updated_at", "review_notes")
MD_STATUSES = ("draft", "reviewed", "verified", "deprecated", "superseded")
MD_TRANSLATED = "<!-- annotation:translated -->"
MD_ORIGINAL = "<!-- annotation:original -->"
MD_END = "<!-- /annotation -->"
MD_CLAIMS_START = "## 주장"
MD_CLAIMS = "## 주장 (claims)"
