"""Schemas (D1-D14) and fixed lookup values.

Everything in the "fixed values" blocks must equal what the transcript service
and its viewer use, so results match; it is stated here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# D1 upload notification
NOTIFICATION_DDL = "Records array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"

# D4 raw transcript (only the fields that are read) + the job name the service writes at top level
RAW_TRANSCRIPT_DDL = (
    "jobName string, "
    "results struct<"
    "speaker_labels:struct<segments:array<struct<start_time:string,end_time:string,speaker_label:string>>>,"
    "items:array<struct<start_time:string,end_time:string,type:string,alternatives:array<struct<content:string>>>>>"
)

SEGMENT_STRUCT = "struct<timestamp:string,speaker:string,text:string>"

# D8 enhanced chunk as returned by the model
ENHANCED_CHUNK_DDL = f"transcript string, segments array<{SEGMENT_STRUCT}>"

# D10 enhanced transcript
ENHANCED_DDL = (
    f"transcript string, segments array<{SEGMENT_STRUCT}>, entities map<string,array<string>>, "
    "s3 struct<transcriptionOutputBucket:string,transcriptionJobName:string>"
)

# D3 job events
JOB_EVENT_DDL = "job_name string, status string, ts timestamp, event_id bigint, uri string"

# ---------------------------------------------------------------------------
# Job states.
JOB_STATES = ("QUEUED", "IN_PROGRESS", "COMPLETED", "FAILED")
TERMINAL_STATES = ("COMPLETED", "FAILED")

# Upload limits and diarization settings.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
AUDIO_MIME_PREFIX = "audio/"
MAX_SPEAKERS = 10
LANGUAGE_CODE = "en-US"
JOB_PREFIX = "stt-"

# Error texts of the status lookup.
MISSING_NAME_ERROR = "Missing fileName parameter"
NO_JOB_ERROR = "Transcription job not found: "
NO_URI_ERROR = "Unexpected error: TranscriptFileUri not found in completed job"
NO_CONTENT_ERROR = "Failed to retrieve transcript content after multiple attempts"
JOB_FAILED_ERROR = "Transcription failed with status: "

# Entity categories, in the order the extractor reports them.
ENTITY_CATEGORIES = (
    "ATTORNEY", "PLAINTIFF", "DEFENDANT", "JUDGE", "WITNESS", "EXPERT", "COMPANY",
    "CASE_NUMBER", "COURT", "DATE", "LOCATION", "STATUTE", "EXHIBIT", "LEGAL_TERM",
)
# categories the entity view leaves out (they go to the case header)
HEADER_ONLY_CATEGORIES = ("CASE_NUMBER", "DATE")

# Display colours per category; anything else is grey.
CATEGORY_COLORS = {
    "ATTORNEY": "hsla(0, 100%, 80%, 0.6)",
    "EXHIBIT": "hsla(120, 70%, 80%, 0.6)",
    "COMPANY": "hsla(210, 100%, 80%, 0.6)",
    "JUDGE": "hsla(50, 100%, 80%, 0.6)",
    "WITNESS": "hsla(180, 70%, 80%, 0.6)",
    "EXPERT": "hsla(300, 70%, 80%, 0.6)",
    "DEFENDANT": "hsla(30, 100%, 80%, 0.6)",
    "COURT": "hsla(270, 70%, 80%, 0.6)",
    "LOCATION": "hsla(150, 70%, 80%, 0.6)",
    "STATUTE": "hsla(90, 70%, 80%, 0.6)",
    "PLAINTIFF": "hsla(240, 70%, 80%, 0.6)",
    "LEGAL_TERM": "hsla(330, 70%, 80%, 0.6)",
}
DEFAULT_COLOR = "hsla(0, 0%, 90%, 0.6)"

# Plural labels used when a category holds more than one value.
PLURAL_LABELS = {
    "ATTORNEY": "ATTORNEYS",
    "PLAINTIFF": "PLAINTIFFS",
    "DEFENDANT": "DEFENDANTS",
    "WITNESS": "WITNESSES",
    "COMPANY": "COMPANIES",
    "LEGAL_TERM": "TERMS",
}
SINGULAR_RENAMES = {"LEGAL_TERM": "TERM"}

# Number words one..fifty -> digits (LOCATION values only).
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15",
    "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20",
    "twenty-one": "21", "twenty-two": "22", "twenty-three": "23", "twenty-four": "24", "twenty-five": "25",
    "twenty-six": "26", "twenty-seven": "27", "twenty-eight": "28", "twenty-nine": "29", "thirty": "30",
    "thirty-one": "31", "thirty-two": "32", "thirty-three": "33", "thirty-four": "34", "thirty-five": "35",
    "thirty-six": "36", "thirty-seven": "37", "thirty-eight": "38", "thirty-nine": "39", "forty": "40",
    "forty-one": "41", "forty-two": "42", "forty-three": "43", "forty-four": "44", "forty-five": "45",
    "forty-six": "46", "forty-seven": "47", "forty-eight": "48", "forty-nine": "49", "fifty": "50",
}


def ddl(s: str) -> T.StructType:
    return T._parse_datatype_string(s)
