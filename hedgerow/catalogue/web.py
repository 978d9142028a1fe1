"""Web lists: signatures, parameter names and the targets that detectors look at."""

# Request-text signatures by family, as a dictionary for log analysis.
REQUEST_SIGNATURES = {
    "basic": (
        "<script>alert(1)</script>",
        "<script>alert('XSS')</script>",
        "<script>alert(document.domain)</script>",
        "<script>confirm(1)</script>",
        "<script>prompt(1)</script>",
    ),
    "html": (
        "<img src=x onerror=alert(1)>",
        "<img src=x onerror=alert(document.domain)>",
        "<body onload=alert(1)>",
        "<svg onload=alert(1)>",
        "<div onmouseover=alert(1)>hover</div>",
        "<iframe src=javascript:alert(1)>",
        "<object data=javascript:alert(1)>",
        "<embed src=javascript:alert(1)>",
    ),
    "encoded": (
        "%3Cscript%3Ealert(1)%3C/script%3E",
        "%3Cimg%20src%3Dx%20onerror%3Dalert(1)%3E",
        "%253Cscript%253Ealert(1)%253C/script%253E",
        "&#60;script&#62;alert(1)&#60;/script&#62;",
        "&#x3C;script&#x3E;alert(1)&#x3C;/script&#x3E;",
        r"\u003cscript\u003ealert(1)\u003c/script\u003e",
        r"\x3cscript\x3ealert(1)\x3c/script\x3e",
    ),
    "events": (
        "onload=alert(1)",
        "onerror=alert(1)",
        "onclick=alert(1)",
        "onmouseover=alert(1)",
        "onmouseenter=alert(1)",
        "onkeydown=alert(1)",
        "onfocus=alert(1)",
        "onblur=alert(1)",
        "onchange=alert(1)",
        "onsubmit=alert(1)",
        "onreset=alert(1)",
        "onselect=alert(1)",
        "onabort=alert(1)",
        "onunload=alert(1)",
        "onbeforeunload=alert(1)",
        "onresize=alert(1)",
        "onscroll=alert(1)",
    ),
    "javascript": (
        "javascript:alert(1)",
        "javascript:alert(document.domain)",
        "javascript:alert('XSS')",
        "javascript:prompt(1)",
        "javascript:confirm(1)",
        "data:text/html,<script>alert(1)</script>",
        "data:text/html;base64,PHNjcmlwdD5hbGVydCgxKTwvc2NyaXB0Pg==",
    ),
    "polyglots": (
        "javascript:alert(1)//<script>alert(1)</script>",
        '" onload=alert(1)>',
        '\'>"<script>alert(1)</script>',
        "'>'><script>alert(1)</script>",
        '"><script>alert(1)</script>',
        "</script><script>alert(1)</script>",
        "';alert(1);//",
        '";alert(1);//',
        "-->alert(1)//",
        "//<script>alert(1)</script>",
    ),
    "dom": (
        "#<script>alert(1)</script>",
        "#<img src=x onerror=alert(1)>",
        "?param=<script>alert(1)</script>",
        "#<svg onload=alert(1)>",
        "#<body onload=alert(1)>",
    ),
    "reflected": (
        "?q=<script>alert(1)</script>",
        "?search=<script>alert(1)</script>",
        "?query=<script>alert(1)</script>",
        "?id=<script>alert(1)</script>",
        "?page=<script>alert(1)</script>",
        "?user=<script>alert(1)</script>",
        "?username=<script>alert(1)</script>",
        "?name=<script>alert(1)</script>",
        "?email=<script>alert(1)</script>",
    ),
    "contextual": (
        '"><script>alert(1)</script>',
        '>"<script>alert(1)</script>',
        '" onload=alert(1)>',
        "' onload=alert(1)>",
        "</script><script>alert(1)</script>",
        "';alert(1);//",
        '";alert(1);//',
        "expression(alert(1))",
        "url(javascript:alert(1))",
    ),
    "evasion": (
        "<ScRiPt>alert(1)</sCrIpT>",
        "<IMG SRC=x onerror=alert(1)>",
        "<script >alert(1)</script>",
        "<img src=x onerror=alert(1) >",
        "%00<script>alert(1)</script>",
        "<scr%00ipt>alert(1)</scr%00ipt>",
        "<!--<script>alert(1)</script>-->",
        "<!--><script>alert(1)</script>-->",
        '"<script>alert(1)</script>"',
        "'<script>alert(1)</script>'",
    ),
}

# Parameter names worth a review.
RISKY_PARAMETERS = (
    "id", "user", "uid", "username", "email", "page", "file", "path", "url", "redirect", "return",
    "next", "token", "apikey", "search", "q", "query", "filter", "sort", "order", "lang", "debug",
    "name", "title", "content", "body", "search", "keyword", "keywords", "term", "category", "tag",
    "label", "user_id", "userid", "account_id", "profile_id", "post_id", "order_id", "invoice_id",
    "ticket_id", "project_id", "document_id", "item_id", "product_id", "category_id", "page_id",
    "comment_id", "redirect", "returnTo", "continue", "destination", "callback", "goto", "forward",
    "to", "target", "href", "link", "api_key", "access_token", "refresh_token", "client_id",
    "client_secret", "grant_type", "scope", "state", "nonce", "test", "dev", "staging", "sandbox",
    "admin", "root", "super", "master", "backup", "config", "settings", "profile", "account",
    "order", "invoice", "payment", "checkout",
)

# Parameters looked at first.
TARGETED_PARAMETERS = (
    "q", "search", "query", "id", "user", "name", "username", "email", "page", "redirect", "url",
    "return", "next", "token", "apikey",
)

# Endpoints whose responses are checked for reflection.
TARGETED_ENDPOINTS = (
    "/search", "/login", "/profile", "/admin", "/upload", "/api/users",
)
