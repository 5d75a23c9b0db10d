"""Row types of the data model (D1-D10), as Spark schema strings. Struct fields stand in ASCII order, so to_json() is canonical."""

CONTEXT = (
    "struct<applicationCategory:string,fieldLabel:string,fieldRole:string,hasAccessibility:boolean,inputSurface:string,isSecure:boolean,selectedText:string,surroundingText:string>"
)
ENTRY = "struct<capabilities:array<string>,id:string,kind:string,sourceCategory:string,text:string>"
LABEL = "struct<abstain_reason:string,acceptable_ids:array<string>,decision:string>"
PREPROCESSING = "struct<tokenizer_sha256:string,truncated:boolean,version:string,visible_sha256:string>"
EPISODE = f"id string, family_id string, context {CONTEXT}, entries array<{ENTRY}>, label {LABEL}, parent_id string, preprocessing {PREPROCESSING}"
SCORES = "id string, candidateScores array<struct<id:string,score:double>>, abstainScore double, latencyMS double, runtime string, error string, bypass string"
FAMILIES = "split string, family_id string, ord int"
AUDIT = (
    "audit_id string, request_id string, phase string, status string, provider string, model string, started_at timestamp, completed_at timestamp, elapsed_seconds double, "
    "prompt_tokens long, completion_tokens long, reasoning_tokens long, attempt_id string"
)
CALIBRATOR = "mean array<double>, scale array<double>, coefficients array<double>, intercept double, threshold double, status string"

#: Fixed values of the enumerations.
KINDS = ("text", "url", "email", "code", "command", "phone", "file", "image", "color")
CATEGORIES = ("browser", "development", "terminal", "mail", "messaging", "writing", "spreadsheet", "creative", "file_management", "unknown")
SURFACES = ("unknown", "text", "recipient", "address_bar", "search", "shell_prompt", "code_editor", "chat_composer", "document", "cell", "color", "file_path", "phone")
CAPABILITIES = ("text", "image", "file", "richText")
ABSTAIN_REASONS = ("no_match", "ambiguous", "insufficient_context")
FAILURES = ("inference_failure", "invalid_request", "remote_unavailable", "model_unavailable", "timeout", "worker_timeout", "error")
SPLITS = ("train", "dev", "calibration", "test")
