"""Record types: one nested row per document, and the tables derived from it."""

SOURCE_REF = "STRUCT<page: INT, section: STRING>"
CKU_DDL = f"""
id STRING,
meta STRUCT<source: STRING, compiled: STRING, hash: STRING, type: STRING, language: STRING, access: STRUCT<roles: ARRAY<STRING>>>,
summaries STRUCT<document: STRING, sections: ARRAY<STRUCT<id: STRING, title: STRING, summary: STRING>>>,
entities ARRAY<STRUCT<id: STRING, name: STRING, type: STRING, relations: ARRAY<STRUCT<target: STRING, type: STRING>>>>,
facts ARRAY<STRUCT<id: STRING, claim: STRING, source: {SOURCE_REF}, confidence: DOUBLE, entities: ARRAY<STRING>>>,
visuals ARRAY<STRUCT<id: STRING, type: STRING, source: {SOURCE_REF}, description: STRING, structured_data: STRING, context: STRING>>,
dependencies ARRAY<STRING>
"""
EVENT_DDL = "id BIGINT, timestamp STRING, event STRING, user STRING, details STRING"
QUESTION_DDL = "id STRING, question STRING, expected_keywords ARRAY<STRING>, category STRING, difficulty STRING"
#: Fixed value: the answer where nothing was found.
NO_ANSWER = "No relevant knowledge found. Have you compiled documents?"

#: A parsed document's page; `at` is where an image link stands in the text.
VISUAL_DDL = "STRUCT<type: STRING, page: INT, bbox: ARRAY<DOUBLE>, data: STRING, at: INT>"
PAGE_DDL = f"STRUCT<number: INT, text: STRING, visuals: ARRAY<{VISUAL_DDL}>>"
PARSED_DDL = f"source STRING, hash STRING, type STRING, pages ARRAY<{PAGE_DDL}>, error STRING"

#: What a provider found in a chunk. `key` is an item's id as JSON (null if there is none), `ok` whether its types fit.
ITEMS = {
    "sections": "STRUCT<key: STRING, ok: BOOLEAN, id: STRING, title: STRING, summary: STRING>",
    "entities": "STRUCT<key: STRING, ok: BOOLEAN, id: STRING, name: STRING, type: STRING, relations: ARRAY<STRUCT<target: STRING, type: STRING>>>",
    "facts": f"STRUCT<key: STRING, ok: BOOLEAN, id: STRING, claim: STRING, source: {SOURCE_REF}, confidence: DOUBLE, entities: ARRAY<STRING>>",
    "visuals": f"STRUCT<key: STRING, ok: BOOLEAN, id: STRING, type: STRING, source: {SOURCE_REF}, description: STRING, structured_data: STRING, context: STRING>",
}
CHUNK_DDL = "document STRING, said STRING, language STRING, dependencies ARRAY<STRING>, " + ", ".join(f"{k} ARRAY<{v}>" for k, v in ITEMS.items())
