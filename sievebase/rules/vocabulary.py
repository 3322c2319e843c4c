"""Fixed values of the file walk: what is skipped and how languages are named."""

# Directories never entered (ignoring case).
SKIPPED_DIRECTORIES = [
    "node_modules", ".git", "bin", "obj", "dist", "build", ".vs", "packages", "vendor",
    "__pycache__", ".next", ".nuxt", "coverage", ".terraform", "migrations", ".idea",
    ".vscode", "bower_components", ".cache", ".parcel-cache", "target",
]

# Extensions never read (ignoring case).
SKIPPED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf", ".exe", ".dll", ".zip", ".tar", ".gz", ".rar",
    ".7z", ".lock", ".min.js", ".min.css", ".map", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".bmp",
    ".webp", ".mp3", ".mp4", ".avi", ".mov", ".so", ".dylib", ".o", ".a", ".lib", ".pdb", ".class", ".jar",
    ".war", ".ear", ".pyc", ".pyo", ".ds_store", ".suo",
]

# Fixed value: files above this size are skipped by the walk; analyzers take a limit of their own.
MAX_FILE_BYTES = 500 * 1024

# Language by extension (ignoring case).
LANGUAGE_BY_EXTENSION = {
    ".cs": "C#", ".csx": "C#", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".py": "Python", ".pyw": "Python", ".java": "Java",
    ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin",
    ".kts": "Kotlin", ".scala": "Scala", ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++", ".cc": "C++",
    ".cxx": "C++", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "SASS",
    ".less": "LESS", ".json": "JSON", ".xml": "XML", ".xaml": "XAML", ".yaml": "YAML", ".yml": "YAML",
    ".md": "Markdown", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell",
    ".ps1": "PowerShell", ".psm1": "PowerShell", ".r": "R", ".lua": "Lua", ".dart": "Dart", ".vue": "Vue",
    ".svelte": "Svelte", ".razor": "Razor", ".cshtml": "Razor", ".tf": "Terraform", ".hcl": "HCL",
    ".dockerfile": "Docker", ".proto": "Protocol Buffers", ".graphql": "GraphQL", ".gql": "GraphQL",
    ".toml": "TOML", ".ini": "INI", ".cfg": "Config", ".conf": "Config", ".env": "Environment",
    ".csproj": "MSBuild", ".sln": "Solution", ".slnx": "Solution", ".gradle": "Gradle", ".cmake": "CMake",
    ".makefile": "Make",
}

# Language by whole file name, tried before the extension.
LANGUAGE_BY_NAME = {
    "dockerfile": "Docker", "makefile": "Make", "gnumakefile": "Make", "gemfile": "Ruby", "rakefile": "Ruby",
    "jenkinsfile": "Groovy", ".gitignore": "Git Config", ".gitattributes": "Git Config",
    ".editorconfig": "EditorConfig", "package.json": "JSON", "tsconfig.json": "JSON",
    "requirements.txt": "Python", "pipfile": "Python", "go.mod": "Go", "go.sum": "Go", "cargo.toml": "Rust",
    "cargo.lock": "Rust",
}

# Hosts repositories may be cloned from.
ALLOWED_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "dev.azure.com"]
