"""Declared schemas; no reader infers one."""

RAW = (
    "corpus_id string, jurisdiction string, source_id string, doc_type string, year int, "
    "url string, body string, fetched_at timestamp"
)
SYNONYMS = "jurisdiction string, dict_version int, alias string, canonical string, expansions array<string>"
GOLDEN = (
    "qa_id string, jurisdiction string, question string, "
    "expected array<struct<act:string,section_no:string>>, must_refuse boolean, tags array<string>"
)
UNDERSTANDING = (
    "jurisdiction string, question_type string, expanded_queries array<string>, "
    "named_acts array<string>, intent string"
)
ANSWER = (
    "direct_answer string, legal_basis string, explanation string, gaps array<string>, "
    "insufficient_context boolean, follow_ups array<string>"
)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PAGES = "page_id bigint, url string, html string"

# Keys of the response contract; ``errors`` is optional.
RESPONSE_KEYS = (
    "provider",
    "answer",
    "structured",
    "sources",
    "results",
    "matchCount",
    "grounded",
    "jurisdiction",
    "corpus_id",
    "writer",
    "suggestedJurisdiction",
)
OPTIONAL_KEYS = ("errors",)

# Jurisdictions of the corpus.
COUNTRIES = ("za", "gb", "us", "ca", "au", "ie", "de", "nz")
# A country of the corpus, or a state as ``us-`` and two letters.
PLACE = f"^(?:{'|'.join(COUNTRIES)}|us-[a-z]{{2}})$"
