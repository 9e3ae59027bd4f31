"""Word lists, patterns, limits and message texts that decide results.

Everything here is data. It is kept in one place and in plain text so that a reader can
compare a verdict or a rendered message with the value that produced it.
"""

# ========================================================================================
# FIXED VALUES: all values below must be exactly these for results to be right.
# ========================================================================================

# --- limits -----------------------------------------------------------------------------
MAX_SCORE = 15
MAX_IMPORT_LINES = 80
MAX_INIT_LINES = 15
MAX_CONSTANT_LINES = 20
MAX_SIBLINGS = 30
MAX_UNTRACKED = 30
MAX_SNIPPET_CHARS = 2400
MAX_BATCH_FILES = 40
MAX_BATCH_CHARS = 40_000
MAX_BATCHES = 12
MAX_DIFF_CHARS = 45_000
MIN_FILE_CHARS = 1800
MAX_FILE_CHARS = 9000
LITE_EXCERPT_CHARS = 3600
LITE_NOTE_CHARS = 5000
MAX_BODY_CHARS = 2800
WEIGHT_PER_LINE = 60
REWRITE_TRIES = 3

# --- path lists -------------------------------------------------------------------------
IGNORED_SEGMENTS = ["tests", "test", "__pycache__", ".git", "node_modules", ".venv", "venv"]

TEXT_EXTENSIONS = [
    ".c", ".cfg", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".ini", ".java",
    ".js", ".json", ".jsx", ".kt", ".md", ".php", ".ps1", ".py", ".rb", ".rs", ".scss",
    ".sh", ".sql", ".swift", ".toml", ".ts", ".tsx", ".txt", ".yaml", ".yml",
]

DUMPED_EXTENSIONS = (
    "py|ps1|md|ts|tsx|js|jsx|json|yml|yaml|toml|sql|sh|go|rs|java|rb|c|cpp|h|hpp|cs|kt|php|swift"
)

# --- code words -------------------------------------------------------------------------
DECISION_WORDS = ["if", "elif", "for", "while", "except", "and", "or", "assert"]
CONTROL_WORDS = ["if", "for", "while", "except"]
BOOLEAN_WORDS = ["and", "or"]
KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise",
    "return", "try", "while", "with", "yield",
]

# --- message gate -----------------------------------------------------------------------
GENERIC_SUBJECTS = [
    "update files", "update code", "update source", "modify files", "modify code",
    "change files", "misc updates", "various updates",
]
GENERIC_VERBS = "update|modify|improve|adjust|refactor"
CHATTY_PREFIXES = [
    "you're ", "you are ", "it looks ", "here's ", "here is ", "below is ",
    "the following ", "this diff ", "this code ", "this script ", "based on ", "###", "## ",
    "let me know", "i'm happy to", "would you like", "please provide", "i can help",
    "need help with",
]
SUMMARY_PREFIXES = [
    "you're ", "you are ", "it looks ", "here's ", "here is ", "below is ",
    "the following ", "this diff ", "this code ", "based on ", "sure", "certainly", "###",
    "## ",
]
ANALYSIS_PHRASES = (
    r"comparing two|version control system|pasted a large|your message|provided git|"
    r"git output|git diff output|summary of the changes|summary of the test files|"
    r"here's a breakdown|key features:|prerequisites:|sample output|in essence|"
    r"\*\*usage:\*\*|\*\*dependencies:\*\*"
)
MESSAGE_PROBLEMS = {
    "empty": "empty output",
    "long": "message is too long",
    "no_subject": "missing subject",
    "bullet_subject": "subject is a bullet path, not a summary",
    "long_subject": "subject is too long",
    "generic": "subject is too generic",
    "chatty": "chat-style explanation",
    "bullets": "too many bullet lines",
    "dump": "file path dump instead of semantic description",
    "numbered": "numbered analysis list instead of commit message",
    "markdown": "markdown analysis bullets instead of commit message",
    "analysis": "analysis prose instead of commit message",
}
SUMMARY_PROBLEMS = {
    "empty": "empty",
    "long": "too long",
    "generic": "generic",
    "dump": "path dump",
    "chatty": "chat-style",
}
MAX_MESSAGE_CHARS = 3200
MAX_SUBJECT_CHARS = 120
MAX_SUMMARY_CHARS = 140
MAX_REDUCED_SUBJECT_CHARS = 100
MAX_BULLETS = 6
ANALYSIS_HEAD_CHARS = 1200

# --- markers ----------------------------------------------------------------------------
TRUNCATED = "\n[... truncated for prompt size ...]"
FILES_OMITTED = "[... additional files omitted for prompt size ...]"
UNTRACKED_TITLE = "-- untracked paths and snippets --"
FENCE = "```"

OMITTED_PATHS = ("[... ", " additional untracked paths omitted ...]")
DIFF_TITLE = ("--- diff for ", " ---\n")
MORE_AREAS = ("- ...and ", " more change areas")
BUNDLE_TITLES = {
    "repo": ("=== REPO: ", " (branch: ", ") ==="),
    "porcelain": "-- git status --porcelain --",
    "name_status": "-- git diff HEAD --name-status --",
    "diff_stat": "-- git diff HEAD --stat --",
    "full": "-- balanced git diff excerpts --",
    "lite": "-- short diff excerpt --",
    "paths-only": "-- untracked paths --",
}
CONTEXT_TITLE = "# File context (for reference only — do not reproduce in your output):"
CONTEXT_SECTIONS = {
    "imports": "## Imports",
    "class": "## Class context",
    "init": "### __init__ attributes",
    "siblings": "### Other methods in the class",
    "constants": "## Module constants",
}

# --- fallback texts ---------------------------------------------------------------------
UPDATE = "Update "
UPDATE_TESTS = "Update tests"
UPDATE_DOCS = "Update documentation"
UPDATE_CONFIG = "Update configuration"
TEST_TOKENS = ["test", "spec"]
DOC_TOKENS = ["readme", ".md", "docs/", "/doc/"]
CONFIG_TOKENS = [".yml", ".yaml", ".toml", ".ini", ".cfg", ".json", "config"]
FALLBACK_BODY = (
    "Apply the changes captured in this commit. Generated automatically because a "
    "model-written summary was unavailable; review and amend if more detail is needed."
)

# --- prompt texts -----------------------------------------------------------------------
PROMPT_REPO = "Repository folder name: "
PROMPT_REJECTED = "\nPrevious output was rejected because: "
REDUCE_PROMPT_HEAD = (" files changed across ", " groups. Below are the group summaries:\n\n")
REWRITE_ASK = ("Refactor the function `", "` to reduce its ", " complexity from ", " to at most ")
REWRITE_TOLD = "IMPORTANT — Previous attempt feedback:\n"
REWRITE_CODE = ("\nFunction to refactor:\n```python\n", "```")
RETRY_ERROR = "Your previous attempt had a validation error: "
RETRY_OVER = ("Function `", "` still has ", " complexity ", " (must be <= ")
LOG_FAILED = "  Validation failed: "
MESSAGE_PROMPT_NOTE = (
    "Machine-readable git output only. Write the commit message from this data; "
    "do not describe the format of the data."
)
SUMMARY_PROMPT_NOTE = (
    "Summarize ONLY the changes in this git diff subset as a single imperative line. "
    "Do not describe the data format and do not output file paths."
)
REPAIR_NOTE = "Write a concrete subject that names the feature, behavior, or contract changed."
DATA_OPEN = "<<<GIT_OUTPUT>>>"
DATA_CLOSE = "<<<END_GIT_OUTPUT>>>"
SUBJECT_PROMPT_HEAD = "The following summarize the distinct changes in ONE commit:"
SUBJECT_PROMPT_TAIL = (
    "Write ONE imperative subject line (max 70 characters) capturing the overall change. "
    "Output only the line."
)
REDUCE_PROMPT_TAIL = (
    "Write ONE git commit message describing the whole change: line 1 a concrete imperative "
    "subject (max 70 chars) naming the overarching change; line 2 blank; then 3 to 6 bullets, "
    "each a distinct recurring theme with duplicates merged. No file paths."
)
LEVEL_NOTES = {
    "full": "",
    "repair-full": (
        "\nIf the prior message was generic or path-only, replace it with a specific semantic "
        "summary and prose body. Do not list files.\n"
    ),
    "lite": (
        "\nGIT_OUTPUT is shortened. Infer intent from paths, stat, snippets, and excerpts, but "
        "do not repeat file paths in the output.\n"
    ),
    "paths-only": (
        "\nGIT_OUTPUT has path lists and stats only. Still write a concrete best-effort subject "
        "and prose body. Do not output the paths.\n"
    ),
}
METRIC_NOTES = {
    "cyclomatic": (
        "Cyclomatic complexity counts linearly independent paths through code. "
        "Each `if`, `elif`, `for`, `while`, `except`, `and`, `or`, `assert`, "
        "and ternary expression adds 1. A function starts at 1."
    ),
    "cognitive": (
        "Cognitive complexity measures how hard code is to understand. "
        "Each `if`, `for`, `while`, `except` adds 1, plus a nesting penalty "
        "equal to the current nesting depth. Boolean sequences (`and`/`or`) "
        "add 1 per sequence. Nesting is the primary driver of high scores."
    ),
}
REWRITE_ROLE = (
    "You are a Python refactoring expert. You reduce function complexity "
    "while preserving exact behavior and all type annotations."
)
REWRITE_RULES = """\
Strategies (use whichever apply):
- Early returns / guard clauses to flatten nesting
- Extract helper functions or methods (preserve `self` for instance methods)
- Replace long if/elif chains with dispatch dicts or mappings
- Replace nested conditionals with guard clauses
- Use comprehensions instead of loop-accumulate patterns
- Decompose compound boolean expressions into named predicates
- Invert conditions to reduce nesting depth

Output rules:
- Return ONLY valid Python code inside a single ```python code fence
- No explanations, no comments about the changes, no markdown outside the fence
- Preserve the original indentation level
- If extracting helpers, place them BEFORE the main function at the same indentation level"""
REWRITE_NEEDS_HEAD = "Requirements:\n- Maintain the same function signature, behavior, and base indentation ("
REWRITE_NEEDS_TAIL = """ spaces)
- You may extract helper functions/methods at the same indent level, placed BEFORE the main function
- If the function is a class method (has `self` parameter), extracted helpers should also be methods with a `self` parameter
- Preserve all type annotations
- Return ONLY Python code inside a single ```python code fence"""
RETRY_ADVICE = (
    "Try a different approach: extract more helpers, use early returns, "
    "replace conditionals with dispatch dicts, or flatten nesting further."
)
TEST_FAILURE_ADVICE = (
    "Your previous attempt caused test failures. Ensure the refactored code preserves exact "
    "behavior — do not change logic, only restructure for lower complexity."
)
NAME_ERROR_HEAD = "Your previous attempt introduced undefined names:\n"
NAME_ERROR_ADVICE = (
    "IMPORTANT: Only use names that are already imported or defined in the file. "
    "Do NOT invent new type names. If you extract a helper function, its parameter "
    "types must use only types visible in the file's import section shown in the context."
)
