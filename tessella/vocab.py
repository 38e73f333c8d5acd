"""Word lists, extension tables and constants."""

from __future__ import annotations

# Results depend on exactly these.
KEYWORDS = (
    "pub fn let mut const use mod impl self crate super struct enum trait type where async await move ref return match loop while "
    "for break continue unsafe static extern dyn true false def class import from pass none elif else try except finally with yield "
    "lambda raise assert del global func var package defer chan select case default goto range void int char float double long short "
    "unsigned signed bool string null nil this new delete throw catch throws extends implements interface abstract final override "
    "virtual protected private public"
).split()

# Fixed values.
SHORT_TERMS = "db fs io ui id ok fn rx tx api vm os gc ip sql cli tls rpc".split()

# Fixed values.
BINARY_EXTENSIONS = (
    ".pyc .pyo .o .so .dylib .dll .bin .exe .a .lib .zip .tar .gz .bz2 .xz .7z .rar .jar .war .whl .pdf .doc .docx .xls .xlsx .ppt "
    ".pptx .png .jpg .jpeg .gif .ico .svg .webp .bmp .tiff .mp3 .mp4 .wav .avi .mov .mkv .db .sqlite .sqlite3 .pkl .npy .npz .onnx .pt "
    ".pth .safetensors .lock"
).split()
MAX_FILE_SIZE = 1_000_000
SNIFFED_BYTES = 8192

# File types by name.
FILE_TYPES = {
    "py": [".py", ".pyi"],
    "js": [".js", ".jsx", ".mjs"],
    "ts": [".ts", ".tsx"],
    "rust": [".rs"],
    "rs": [".rs"],
    "go": [".go"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh"],
    "cs": [".cs"],
    "rb": [".rb"],
    "php": [".php"],
    "sh": [".sh", ".bash", ".zsh"],
    "md": [".md", ".markdown"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "toml": [".toml"],
}
NOT_CODE = ["*.md", "*.markdown", "*.txt", "*.rst", "*.adoc"]
MARKDOWN = [".md", ".mdx", ".markdown"]
PLAIN_TEXT = [".txt", ".rst"]

# Block types.
CONTAINERS = ["class", "struct", "module", "impl", "trait", "enum", "interface", "block"]
DOC_TYPES = ["text", "section"]
CLASS_WORDS = ["class", "struct", "type"]
FUNCTION_WORDS = ["function", "func", "fn", "method", "def"]

# Chunking, in estimated tokens of four bytes.
CHUNK_TOKENS, OVERLAP_WORDS, MIN_CHUNK_TOKENS, HEAD_LINES = 400, 50, 30, 50

# Embedding.
VECTOR_DIMS, MAX_STORED_TOKENS, MAX_DOC_TOKENS, MAX_QUERY_TOKENS = 48, 512, 1024, 256

#: Our own default synonyms for expanding queries; a fuller table is a parameter of every function that uses them.
SYNONYMS = {
    "auth": ["login", "token", "session", "credential"],
    "click": ["press", "tap", "select"],
    "config": ["settings", "options"],
    "connect": ["open", "socket"],
    "db": ["database", "store"],
    "delete": ["remove", "drop"],
    "error": ["exception", "failure"],
    "fetch": ["get", "load"],
    "file": ["path", "document"],
    "login": ["auth", "signin", "session"],
    "parse": ["read", "decode"],
    "purchase": ["buy", "order", "payment"],
    "search": ["query", "find", "lookup"],
    "signup": ["register", "join"],
    "test": ["check", "assert", "verify"],
    "view": ["show", "display"],
}
