"""Declared schemas of the tables that the engine reads, passes on and writes."""

TURN = "struct<role:string,content:string>"
RAW_ITEMS = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>,"
    f" haystack_session_ids array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"
)
RAW_GROUPS = "conversation map<string, string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:string>>"
MESSAGES = "array<struct<speaker:string,text:string,blip_caption:string>>"
CORPUS = "session_time string, context string, session_id string, title string"
QUESTIONS = "question string, answer string, question_type string, question_time string, origin string, label string"
CHUNKS = "chunk_id bigint, doc_id bigint, session_id string, session_time string, text string"
DOC_CHUNKS = "chunk_id bigint, doc_id bigint, title string, text string, start_idx int, end_idx int, token_count int"
ENTITIES = "ordinal bigint, entity string, type string, description string, chunk_id bigint, doc_id bigint, session_id string, session_time string"
RELATIONS = "ordinal bigint, src string, dst string, relation string, strength int, weight double, session_time string, session_id string, chunk_id bigint, doc_id bigint"
NODES = "name string, entity_type string, chunk_id bigint, description string, embedding array<float>"
EDGES = (
    "src string, dst string, relation string, chunk_id bigint, chunk_ids array<bigint>, session_id string, session_ids array<string>,"
    " session_time string, session_times array<string>, strength int, weight double, description string, embedding array<float>"
)
THEMES = "array<struct<i:int,title:string,summary:string>>"
SUMMARIES = f"session_id string, session_time string, keys string, themes {THEMES}, embedding array<float>, summary_status string, error string"
RESULTS = "id bigint, question string, answer string, output string, question_type string, origin array<string>, top_session_ids array<string>"
USAGE = "stage string, model string, prompt_tokens bigint, completion_tokens bigint"
ENTITY_TYPES = ("person", "time", "organization", "event", "concept", "object", "location")
