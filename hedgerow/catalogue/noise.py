"""Noise lists: which directories, files and lines are left out of a scan."""

# Directory names never descended into.
SKIP_DIRS = (
    ".next", "_next", "out", "dist", "build", "public", "static", "assets", ".cache",
    "node_modules", "bower_components", "vendor", "venv", ".venv", "env", ".env", "__pycache__",
    ".git", ".idea", ".vscode",
)

# Extensions that are read at all.
SCAN_EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".py", ".php", ".rb", ".java", ".go", ".rs",
    ".c", ".cpp", ".h", ".hpp", ".sh", ".bash", ".xml", ".json", ".yml", ".yaml", ".conf", ".sql",
    ".vue", ".svelte", ".env", ".txt", ".ini", ".cfg", ".properties", ".toml", ".twig", ".j2",
    ".ejs", ".pug", ".hbs",
)

# Largest file read, in bytes.
MAX_FILE_BYTES = 10 * 1024 * 1024

# A path that matches any of these is a library or a build product.
SKIP_PATH_PATTERNS = (
    "jquery", "bootstrap", "react", "vue", "angular", "lodash", "underscore", "moment", "axios",
    "swiper", "slick", "chart", "d3", "three", "gsap", "anime", "fabric", "konva", "pixi",
    "phaser", "babylon", "vendor", "polyfills", "runtime", "webpack", "chunk", "bundle",
    r"min\.js", "map$", r"^inline_js_\d+\.js$", r"^[a-z0-9_-]{8,}\.js$",
    r"^[a-z0-9_-]{8,}-[a-z0-9_-]*\.js$",
)

# Basenames of extracted inline scripts and of hashed bundles.
SKIP_BASENAME_PATTERNS = (
    r"^inline_js_\d+\.js$", r"^[a-z0-9_-]{8,}\.js$", r"^[a-z0-9_-]{8,}-[a-z0-9_-]*\.js$",
)

# A line that matches any of these is framework, tracker or bundler noise.
SKIP_LINE_PATTERNS = (
    r"console\.", "// @ts-", "// eslint-", r"/\* eslint-", '"use strict"', "'use strict'",
    r"module\.exports", r"exports\.", r"require\(", r"import\s+", r"export\s+", "sourceMappingURL",
    "@license", "@preserve", "__webpack_", "__NEXT_DATA__", "__next_s", "data-nscript",
    "TURBOPACK", "typeof window", "typeof document", r"process\.env", "__DEV__", "__react_refresh",
    r"useState\(", r"useEffect\(", r"useContext\(", r"useReducer\(", r"useCallback\(",
    r"useMemo\(", r"useRef\(", r"forwardRef\(", r"createElement\(", r"React\.", "react/",
    "google-analytics", r"gtag\(", "dataLayer", r"gtm\.", "google_tag_manager", r"fbq\(", r"twq\(",
    r"linkedin\.", "pinterest", "snapchat", "tiktok", "cookie-consent", "cookieconsent",
    "Cookiebot", "OneTrust", "CookieNotice", r"cookies\.js", r"analytics\.", "hotjar", "crazyegg",
    "fullstory", "mixpanel", "amplitude", r"segment\.", r"heap\.", "logrocket", r"sentry\.",
    "datadog", "newrelic", "cloudflare", "cf-beacon", "recaptcha", "hcaptcha", "turnstile",
    r"facebook\.com/plugins", r"twitter\.com/widgets", r"instagram\.com/embed",
    r"youtube\.com/embed", r"vimeo\.com/embed", r"soundcloud\.com/player", r"spotify\.com/embed",
    r"cdn\.", r"gstatic\.com", r"cloudfront\.net", r"fonts\.googleapis\.com", r"\(self\.__next_s=",
    "__NEXT_DATA__", 'data-nscript="', "next-script", "__webpack_require__",
    "__webpack_public_path__", "webpackChunk", "webpackJsonp", "__vite_", "__rollup_",
    "__esbuild_",
)

# A line that starts with one of these is a comment.
COMMENT_STARTS = ("//", "/*")

# A line that is only one of these tokens.
LONE_TOKENS = (
    "{", "}", "(", ")", "[", "]", ";", "=>", "->", ":", ",",
)

# A script line that contains one of these (case matters) is left out.
SCRIPT_LINE_SKIPS = (
    "console.log", "console.error", "module.exports", "export default", "import React",
)

# Shortest line looked at in a web page or script, after stripping.
MIN_LINE_CHARS = 10

# A script of fewer lines and more characters than these is minified.
MINIFIED_LINES = 5
MINIFIED_CHARS = 10000

# An endpoint that matches any of these is a build product.
BUILD_ARTIFACT_PATTERNS = (
    "/_next/", "/static/", "/chunks/", "/images/", "/fonts/", "/icons/", r"/favicon\.",
    r"/manifest\.", r"\.woff2?$", r"\.ttf$", r"\.eot$", r"\.svg$", r"\.png$", r"\.jpg$",
    r"\.jpeg$", r"\.gif$", r"\.ico$", r"\.webp$", r"\.css$", r"\.map$", "__next", "webpack",
    "chunk-", "framework-", "polyfills", "runtime", "vendor",
)

# Words near a match that mark it as sanitised.
SANITISER_WORDS = (
    "sanitize", "escape", "encode", "DOMPurify", "htmlspecialchars", "strip_tags", "filter_var",
    "prepared", "bindparam", "paramstyle", "validate", "whitelist", "allowlist",
)

# The context of a match, in lines before and after it.
CONTEXT_BEFORE = 2
CONTEXT_AFTER = 3

# The post-filter of likely real findings.
HASHED_SCRIPT_PATTERN = r"[a-f0-9]{10,}\.js$"
LIBRARY_WORDS = ("vendor", "chunk", "polyfill", "runtime")
REAL_SNIPPET_WORDS = ("userInput", "request.")
REAL_CATEGORY = "NETWORK"
