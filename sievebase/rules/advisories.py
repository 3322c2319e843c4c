"""Known vulnerable packages.

Fixed values: package, first safe version and severity decide what is reported.
The remarks are free text.
"""

C, W, I = "Critical", "Warning", "Info"

# Package, first safe version, severity, advisory id, remark.
NPM = [
    ("lodash", "4.17.21", C, "CVE-2021-23337", "prototype pollution"),
    ("axios", "0.21.2", W, "CVE-2021-3749", "request forgery"),
    ("node-fetch", "2.6.7", W, "CVE-2022-0235", "open redirect"),
    ("minimist", "1.2.6", W, "CVE-2021-44906", "prototype pollution"),
    ("tar", "6.1.9", C, "CVE-2021-37713", "path traversal"),
    ("jquery", "3.5.0", W, "CVE-2020-11022", "script injection"),
    ("moment", "2.29.4", I, "CVE-2022-24785", "slow expressions"),
    ("serialize-javascript", "3.1.0", C, "CVE-2020-7660", "code execution"),
    ("express", "4.17.3", W, "", "outdated"),
    ("jsonwebtoken", "9.0.0", C, "CVE-2022-23529", "verification bypass"),
    ("multer", "1.4.4", W, "CVE-2022-24434", "denial of service"),
    ("ejs", "3.1.8", C, "CVE-2022-29078", "code execution"),
    ("vm2", "3.9.11", C, "CVE-2022-36067", "sandbox escape"),
    ("glob", "9.0.0", W, "", "path traversal"),
    ("socket.io-parser", "4.2.3", C, "CVE-2022-21670", "prototype pollution"),
    ("ua-parser-js", "0.7.33", C, "CVE-2022-25927", "supply chain"),
]
PYTHON = [
    ("Django", "3.2.14", C, "", "injection and more"),
    ("Flask", "2.0.0", W, "", "outdated"),
    ("Pillow", "9.0.1", W, "CVE-2022-22815", "buffer overflow"),
    ("PyYAML", "6.0", C, "CVE-2020-14343", "code execution"),
    ("requests", "2.27.0", W, "", "outdated"),
    ("cryptography", "36.0.0", W, "", "outdated"),
    ("urllib3", "1.26.5", W, "CVE-2021-33503", "cache poisoning"),
    ("jinja2", "3.0.3", W, "CVE-2022-29969", "script injection"),
]
DOTNET = [
    ("Newtonsoft.Json", "13.0.1", W, "CVE-2021-26701", "deserialization"),
    ("System.Text.Encodings.Web", "4.5.1", C, "CVE-2021-26701", "encoding bypass"),
    ("log4net", "2.0.13", C, "CVE-2018-1285", "external entities"),
]

# When each list was last brought up to date, and how long it holds.
LAST_UPDATED = {"npm": "2024-11-15", "python": "2024-11-15", "dotnet": "2024-11-15"}
STALE_AFTER_DAYS = 90
