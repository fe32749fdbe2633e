"""Fixed values.

Everything in this module has to equal the published behaviour for results to
match, so it is stated as plain text and never computed.
"""

# File extension (lower case, with the dot) -> language.
LANGUAGE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".rb": "ruby",
    ".php": "php",
    ".java": "java",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rs": "rust",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".r": "r",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "shell",
    ".pl": "perl",
    ".pm": "perl",
    ".t": "perl",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "scss",
    ".less": "less",
    ".xml": "xml",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".md": "markdown",
    ".sql": "sql",
    ".lua": "lua",
    ".vim": "vim",
    ".el": "elisp",
    ".clj": "clojure",
    ".ex": "elixir",
    ".exs": "elixir",
    ".erl": "erlang",
    ".hs": "haskell",
    ".ml": "ocaml",
    ".mli": "ocaml",
}

# Interpreter name looked for in a "#!" line -> language.
LANGUAGE_BY_SHEBANG = {
    "python": "python",
    "ruby": "ruby",
    "node": "javascript",
    "php": "php",
    "perl": "perl",
    "bash": "shell",
    "sh": "shell",
    "zsh": "shell",
    "fish": "shell",
    "lua": "lua",
    "R": "r",
}

# Fixed value: language of a file no rule recognises.
UNKNOWN_LANGUAGE = "unknown"

# Ignore patterns of the default configuration.
DEFAULT_IGNORE_PATTERNS = (
    ".next",
    "webpack",
    ".contentlayer",
    ".git",
    "node_modules",
    ".idea",
    "vendor",
    "*.exe",
    "*.dll",
    "*.so",
    "*.dylib",
    "*.bin",
    "*.dat",
    "_build",
    "deps",
)

# Limits and sizes of the default configuration.
DEFAULT_MAX_FILE_SIZE = 4 * 1024 * 1024
DEFAULT_CHUNK_SIZE = 4096
DEFAULT_CHUNK_OVERLAP = 200
DEFAULT_MAX_TOKENS = 2000

# The binary test reads this many bytes and compares this share.
BINARY_SAMPLE_BYTES = 512
BINARY_SHARE = 0.3

# Lines shown by a preview, and lines shown before the match.
PREVIEW_LINES = 1000
PREVIEW_CONTEXT = 5

# Fixed value: a line of this many bytes is too long for comment stripping and
# for reading a "#!" line.
LONG_LINE_BYTES = 65536

# Shape of a directory tree line.
TREE_ROOT_LINE = "."
TREE_INDENT = "  "
TREE_BRANCH = "├── "

# Unicode white space, as the inside of a regex character class.
SPACE_CLASS = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The multi-byte members of that set as UTF-8 byte sequences, for
# text that is read one byte per character.
SPACE_BYTES_WIDE = (
    r"\x{C2}[\x{85}\x{A0}]|\x{E1}\x{9A}\x{80}"
    r"|\x{E2}\x{80}[\x{80}-\x{8A}\x{A8}\x{A9}\x{AF}]"
    r"|\x{E2}\x{81}\x{9F}|\x{E3}\x{80}\x{80}"
)

# Byte values that count as non-printable in the binary test.
NON_PRINTABLE_CLASS = r"\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}"

# What a letter of a query gains or loses by the place it is found in.
ALIGN_START = 10
ALIGN_AFTER_SEPARATOR = 20
ALIGN_CAMEL_CASE = 20
ALIGN_ADJACENT = 5
ALIGN_LEADING_GAP = 5
ALIGN_MOST_LEADING_GAP = 15
ALIGN_UNMATCHED = 1
ALIGN_SEPARATORS = "/-_. \\"
