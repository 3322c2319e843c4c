"""Data-flow catalogues.

Fixed values: patterns, labels and words decide which flows are reported.
"""

# Where user input enters (pattern, label).
SOURCES = [
    (r"req\.(body|params|query|headers)\b", "Express req"),
    (r"request\.(body|params|query)\b", "Express request"),
    (r"Request\.(Form|Query|Headers)\[", "ASP.NET Request"),
    (r"\[From(Body|Query|Route|Form)\]", "ASP.NET Binding"),
    (r"request\.(GET|POST|data)\[", "Django request"),
    (r"request\.(form|args|json)\[", "Flask request"),
    (r"@RequestParam|@PathVariable|@RequestBody", "Spring Binding"),
    (r"\$_(GET|POST|REQUEST|COOKIE)\[", "PHP superglobal"),
    (r'params\[:\w+\]|params\["\w+"\]', "Rails params"),
    (r'@Param\s*\(\s*"\w+"\s*\)', "JPA Param"),
]
# A file without any of these holds no source.
SOURCE_HINT = r"req(uest)?\.|Request\.|\[From|@RequestParam|@PathVariable|@RequestBody|\$_|params\[|@Param"

SQL, XSS = "SQL Injection", "Cross-Site Scripting (XSS)"
# Where input does harm (pattern, kind, weakness).
SINKS = [
    (r"(?i)(\.query|\.execute|cursor\.execute|ExecuteReader|ExecuteNonQuery|ExecuteScalar|SqlCommand|mysql_query|pg_query|mysqli_query|pdo->query|sqlite3_exec)\s*\(", "Database Query", SQL),
    (r'(?i)"""(SELECT|INSERT|UPDATE|DELETE)\s.+?"""\s*\+', "SQL String Concat", SQL),
    (r'(?i)\$"""(SELECT|INSERT|UPDATE|DELETE)\s', "SQL Interpolation", SQL),
    (r'(?i)f"""(SELECT|INSERT|UPDATE|DELETE)\s', "SQL f-string", SQL),
    (r"\.innerHTML\s*=", "innerHTML", XSS),
    (r"document\.write\s*\(", "document.write", XSS),
    (r"Html\.Raw\s*\(", "Html.Raw", XSS),
    (r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML", XSS),
    (r"v-html\s*=", "Vue v-html", XSS),
    (r"\{\{\{\s*\w+\s*\}\}\}", "Triple Mustache (raw HTML)", XSS),
    (r"(child_process\.exec|os\.system|subprocess\.(call|run|Popen)|Runtime\.exec|Process\.Start|shell_exec|exec\s*\(|system\s*\(|passthru\s*\(|popen\s*\()", "Command Exec", "Command Injection"),
    (r"(fs\.readFile|fs\.writeFile|fs\.createReadStream|open\s*\(|File\.Open|fopen|file_get_contents|readfile)\s*\([^)]*\+", "File Operation", "Path Traversal"),
    (r"(HttpClient|fetch|axios|request|curl|wget)\s*\(\s*[^)]*\+", "HTTP Request", "Server-Side Request Forgery (SSRF)"),
    (r"(DirectorySearcher|LdapConnection|ldap_search)\s*\(", "LDAP Query", "LDAP Injection"),
    (r"(SelectNodes|SelectSingleNode|xpath)\s*\([^)]*\+", "XPath Query", "XPath Injection"),
]

# Words taken as a check of the input.
SANITIZER = (
    r"(?i)\b(validate|sanitize|escape|encode|parameterize|prepared|addWithValue|SqlParameter|htmlEncode|encodeURI"
    r"|encodeURIComponent|DOMPurify|bleach\.clean|strip_tags|htmlspecialchars|mysql_real_escape|pg_escape|xss|purify"
    r"|clean|filter|trim|strip|whitelist|blacklist|regex|pattern|match|sanitize_html|encode_for|owasp|validator"
    r"|constraint|@Valid|@Validated|@NotNull|@NotEmpty|@Size|@Pattern|@Email|@SafeHtml)\b"
)

# Function definitions and exports.
FUNCTION = (
    r"(?:function\s+(\w+)"
    r"|(?:public|private|protected|internal|static|async|export)\s+.*?(?:function|const|let|var)?\s*(\w+)\s*\("
    r"|(\w+)\s*(?:=|:)\s*(?:async\s+)?\(?:\s*(?:\w+(?:,\s*\w+)*)?\s*\)\s*=>"
    r"|def\s+(\w+)\s*\("
    r"|class\s+(\w+))"
)
FUNCTION_GROUPS = 5
EXPORT = r"(?:module\.exports|export\s+(?:default\s+)?(?:function|const|class)|export\s+\{[^}]*\})"
EXPORTED_NAME = r"export\s+(?:default\s+)?(?:function|const|class|let|var)?\s*(\w+)"

# Parts of a source expression that are not its variable.
NOT_A_VARIABLE = ["req", "request", "body", "params"]

# Lines searched after a source.
CALL_WINDOW, PROPERTY_WINDOW = 50, 30
