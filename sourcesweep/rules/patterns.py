"""Pattern rules: what each rule looks for, how bad it is, and what it is called.

Everything in :data:`PATTERNS` is a fixed value: the regular expressions, severities and issue
titles define which findings a scan returns, so they are stated as they are.  Expressions are
written in Python ``re`` syntax; :mod:`sourcesweep.functions.regex` adapts them to Spark.

Layout: ``(family, language): (ignore_case, [(number, severity, issue, pattern), ...])``.
``CRITICAL/HIGH`` means HIGH when the file uses a known sanitizer.
"""

# --- fixed values ---------------------------------------------------------------------------
# fmt: off
PATTERNS = {
    ("LINE", "ANY"): (True, [
        (1, "CRITICAL", "Hardcoded Credential in XML",
         r"""<Value>([A-Z0-9]{20,}|[a-zA-Z0-9\-_]{20,})</Value>"""),
        (2, "CRITICAL", "Hardcoded Password",
         r"""(password|pwd|pass)\s*=\s*["\'][^"\']+["\']"""),
        (3, "HIGH", "Potential SQL Injection",
         r"""(\bselect\b|\binsert\b|\bupdate\b|\bdelete\b).*(\+|\%s|\{}).*"""),
        (4, "LOW", "Debug Mode Enabled",
         r"""(debug\s*=\s*True|DEBUG\s*=\s*True)"""),
        (5, "HIGH", "Hardcoded API Key",
         r"""(api[_-]?key|apikey|secret[_-]?key)\s*=\s*["\'][^"\']+["\']"""),
        (6, "MEDIUM", "Insecure Random",
         r"""random\.\w+\(\)|Math\.random\(\)"""),
        (7, "MEDIUM", "HTTP Without TLS",
         r"""http://[^\s"\']+"""),
    ]),
    ("SQLI", "PHP"): (True, [
        (1, "CRITICAL", "SQL Query String Concatenation",
         r"""(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*\..*\$"""),
        (2, "CRITICAL", "User Input in SQL Query",
         r"""(SELECT|INSERT|UPDATE|DELETE).*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (3, "CRITICAL", "Deprecated mysql_query()",
         r"""mysql_query\s*\("""),
        (4, "HIGH", "mysqli_query with concatenation",
         r"""mysqli_query\s*\([^,]+,\s*["\']?(SELECT|INSERT|UPDATE|DELETE).*(\$|\.)"""),
        (5, "HIGH", "String Interpolation in SQL",
         r"""(SELECT|INSERT|UPDATE|DELETE).*"\s*\.\s*\$|"\s*\{\$"""),
        (6, "HIGH", "PDO query() with variables",
         r"""\$\w+->query\s*\(\s*["\']?(SELECT|INSERT|UPDATE|DELETE).*\$"""),
    ]),
    ("SQLI", "JS"): (True, [
        (1, "CRITICAL", "SQL Template Literal Injection",
         r"""`(SELECT|INSERT|UPDATE|DELETE).*\$\{"""),
        (2, "CRITICAL", "SQL String Concatenation",
         r"""["\']?(SELECT|INSERT|UPDATE|DELETE)["\']?\s*\+\s*\w+"""),
        (3, "CRITICAL", "Unsafe Database Query",
         r"""\.query\s*\(\s*`?(SELECT|INSERT|UPDATE|DELETE).*\$\{"""),
        (4, "HIGH", "Sequelize Raw Query Injection",
         r"""sequelize\.query\s*\(\s*`.*\$\{"""),
        (5, "CRITICAL", "User Input in SQL Query",
         r"""(SELECT|INSERT|UPDATE|DELETE).*(req\.query|req\.body|req\.params)"""),
    ]),
    ("SQLI", "PY"): (True, [
        (1, "CRITICAL", "SQL String Formatting",
         r"""(SELECT|INSERT|UPDATE|DELETE).*%s|\.format\("""),
        (2, "CRITICAL", "SQL F-String Injection",
         r"""f["\']?(SELECT|INSERT|UPDATE|DELETE).*\{"""),
        (3, "CRITICAL", "SQL String Concatenation",
         r"""["\']?(SELECT|INSERT|UPDATE|DELETE)["\']?\s*\+\s*\w+"""),
        (4, "CRITICAL", "execute() with F-String",
         r"""\.execute\s*\(\s*f["\']"""),
        (5, "HIGH", "Django Raw SQL with F-String",
         r"""\.raw\s*\(\s*f["\']"""),
    ]),
    ("SQLI", "JAVA"): (True, [
        (1, "HIGH", "Using Statement instead of PreparedStatement",
         r"""Statement\s+\w+\s*=.*createStatement\("""),
        (2, "CRITICAL", "SQL String Concatenation",
         r"""\.execute(Query|Update)\s*\(\s*".*"\s*\+"""),
        (3, "HIGH", "String.format() in SQL Query",
         r"""String\.format\s*\(.*SELECT|INSERT|UPDATE|DELETE"""),
    ]),
    ("XSS", "JS"): (True, [
        (1, "CRITICAL/HIGH", "Unsafe innerHTML Assignment",
         r"""\.innerHTML\s*=\s*(?!["\'`])[^;]+"""),
        (2, "CRITICAL/HIGH", "dangerouslySetInnerHTML in React",
         r"""dangerouslySetInnerHTML\s*=\s*\{\{.*__html:"""),
        (3, "CRITICAL", "Dangerous eval() Usage",
         r"""\beval\s*\("""),
        (4, "HIGH", "Function Constructor Usage",
         r"""new\s+Function\s*\("""),
        (5, "HIGH", "Unsafe document.write()",
         r"""document\.write\s*\(\s*(?!["\'])"""),
        (6, "HIGH", "Unsafe outerHTML Assignment",
         r"""\.outerHTML\s*=\s*(?!["\'`])"""),
        (7, "HIGH", "Unsafe insertAdjacentHTML",
         r"""\.insertAdjacentHTML\s*\([^,]+,\s*(?!["\'])"""),
        (8, "HIGH", "Unsafe jQuery .html()",
         r"""\$\([^)]+\)\.html\s*\(\s*(?!["\'])"""),
        (9, "HIGH", "Vue v-html Directive",
         r"""v-html\s*=\s*["\']?(?!sanitize)"""),
        (10, "MEDIUM", "Open Redirect via location.href",
         r"""location\.href\s*=\s*.*(req\.|params|query|body|input|user)"""),
    ]),
    ("XSS", "PHP"): (True, [
        (1, "CRITICAL", "Unescaped Echo of User Input",
         r"""echo\s+\$_(GET|POST|REQUEST|COOKIE)|echo\s+.*\$_(GET|POST|REQUEST|COOKIE)"""),
        (2, "CRITICAL", "Unescaped Print of User Input",
         r"""print\s+\$_(GET|POST|REQUEST|COOKIE)"""),
        (3, "CRITICAL", "Unescaped Short Echo Tag",
         r"""<\?=\s*\$_(GET|POST|REQUEST|COOKIE)"""),
        (4, "HIGH", "Direct Variable in HTML",
         r"""<[^>]*>\s*\$_(GET|POST|REQUEST|COOKIE)"""),
        (5, "CRITICAL", "Dangerous eval() Usage",
         r"""\beval\s*\("""),
        (6, "HIGH", "Deprecated create_function()",
         r"""create_function\s*\("""),
    ]),
    ("XSS", "HTML"): (True, [
        (1, "HIGH", "Variable in Inline Event Handler",
         r"""on\w+\s*=\s*["\'][^"\']*\$\{|on\w+\s*=\s*["\'][^"\']*<%="""),
        (2, "HIGH", "Variable in javascript: URL",
         r"""href\s*=\s*["\']javascript:.*\$\{|href\s*=\s*["\']javascript:.*<%="""),
    ]),
    ("XSS", "VUE"): (False, [
        (1, "HIGH", "Unsafe v-html Directive",
         r"""v-html\s*=\s*["\'](?!.*sanitize)(?!.*DOMPurify)"""),
    ]),
    ("XSS", "PY"): (False, [
        (1, "CRITICAL", "Unsafe render_template_string",
         r"""render_template_string\s*\([^)]*\+|render_template_string\s*\(f["\']"""),
        (2, "HIGH", "Django mark_safe Usage",
         r"""mark_safe\s*\("""),
        (3, "HIGH", "Django |safe Filter",
         r"""\|\s*safe\s*[}\]]"""),
    ]),
    ("AUTH", "JS"): (True, [
        (1, "CRITICAL", "Unprotected Critical Route",
         r"""app\.(post|put|delete|patch)\s*\(\s*["\'][^"\']*(delete|remove|admin|destroy|update|create)[^"\']*["\'](?!.*authenticat)(?!.*requireAuth)"""),
        (2, "CRITICAL", "Unprotected Hono Route",
         r"""app\.(post|put|delete|patch)\s*\(\s*["\'][^"\']*(delete|remove|admin|destroy|update|create)[^"\']*["\'](?!.*auth)"""),
        (3, "HIGH", "Next.js API Route Without Auth",
         r"""export\s+(default\s+)?async\s+function\s+(POST|PUT|DELETE|PATCH)\s*\([^)]*\)\s*\{(?!.*session)(?!.*auth)"""),
        (4, "CRITICAL", "Plain Text Password Comparison",
         r"""(password|pwd)\s*===?\s*(password|pwd)|if\s*\(\s*(password|pwd)\s*=="""),
        (5, "CRITICAL", "Storing Password Without Hashing",
         r"""(password|pwd)\s*:\s*(req\.body\.password|password)(?!.*hash)(?!.*bcrypt)(?!.*crypto)"""),
        (6, "CRITICAL", "JWT Decode Without Verification",
         r"""jwt\.decode\s*\((?!.*verify)"""),
        (7, "HIGH", "Weak JWT Secret",
         r"""jwt\.(sign|verify)\s*\([^,]+,\s*["\'](\w{1,15}|secret|test|dev)["\']"""),
    ]),
    ("AUTH", "PHP"): (True, [
        (1, "CRITICAL", "Plain Text Password Comparison",
         r"""(password|pwd)\s*===?\s*\$_(GET|POST|REQUEST)|if\s*\(\s*\$_\w+\[["\']password["\']\]\s*=="""),
        (2, "CRITICAL", "Storing Password Without Hashing",
         r"""(INSERT|UPDATE).*password.*\$_(GET|POST|REQUEST)(?!.*password_hash)"""),
        (3, "CRITICAL", "Using MD5/SHA1 for Passwords",
         r"""(md5|sha1)\s*\(\s*\$_(GET|POST|REQUEST)\[["\']password["\']\]"""),
        (4, "MEDIUM", "Session Fixation Risk",
         r"""\$_SESSION\[["\']user|session_start\(\)(?!.*session_regenerate_id)"""),
        (5, "LOW", "Unsafe Session Check",
         r"""if\s*\(\s*\$_SESSION\[["\'](?!.*isset)"""),
    ]),
    ("AUTH", "PY"): (True, [
        (1, "CRITICAL", "Flask Route Without Auth Decorator",
         r"""@app\.route\([^)]*(delete|remove|admin|destroy|update|create)[^)]*\)(?!.*@login_required)(?!.*@require)"""),
        (2, "HIGH", "Django View Without Auth",
         r"""def\s+(delete|remove|admin|destroy|update|create)\w*\s*\([^)]*request[^)]*\):(?!.*@login_required)(?!.*@permission_required)"""),
        (3, "CRITICAL", "Plain Text Password Comparison",
         r"""(password|pwd)\s*==\s*(password|pwd)|if\s+password\s*=="""),
        (4, "HIGH", "Using hashlib for Passwords",
         r"""hashlib\.(md5|sha1|sha256)\s*\(.*password"""),
        (5, "CRITICAL", "JWT Signature Verification Disabled",
         r"""jwt\.decode\s*\([^,]+,\s*options\s*=\s*\{[^}]*"verify_signature"\s*:\s*False"""),
    ]),
    ("CMD", "PHP"): (True, [
        (1, "CRITICAL", "exec() with User Input",
         r"""exec\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$argv)"""),
        (2, "CRITICAL", "system() with User Input",
         r"""system\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$argv)"""),
        (3, "CRITICAL", "shell_exec() with User Input",
         r"""shell_exec\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$argv)"""),
        (4, "CRITICAL", "passthru() with User Input",
         r"""passthru\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$argv)"""),
        (5, "HIGH", "Backtick Command with Variable",
         r"""`[^`]*\$"""),
        (6, "HIGH", "popen() with User Input",
         r"""popen\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (7, "HIGH", "proc_open() with User Input",
         r"""proc_open\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (8, "HIGH", "Command String Concatenation",
         r"""(exec|system|shell_exec|passthru)\s*\([^)]*\.\s*\$"""),
    ]),
    ("CMD", "JS"): (True, [
        (1, "CRITICAL", "child_process.exec with User Input",
         r"""(exec|execSync)\s*\(\s*[^)]*\$\{|exec\s*\([^)]*\+|exec\s*\([^)]*req\.(query|body|params)"""),
        (2, "CRITICAL", "exec() with Template Literal",
         r"""exec\s*\(\s*`[^`]*\$\{"""),
        (3, "HIGH", "spawn() with shell: true",
         r"""spawn\s*\([^)]*\{[^}]*shell\s*:\s*true"""),
        (4, "CRITICAL", "eval() with User Input",
         r"""eval\s*\([^)]*req\.(query|body|params)"""),
    ]),
    ("CMD", "PY"): (False, [
        (1, "CRITICAL", "os.system with User Input",
         r"""os\.system\s*\([^)]*\+|os\.system\s*\(f["\']"""),
        (2, "HIGH", "subprocess with shell=True",
         r"""subprocess\.(call|run|Popen)\s*\([^)]*shell\s*=\s*True"""),
        (3, "CRITICAL", "subprocess with F-String",
         r"""subprocess\.(call|run|Popen)\s*\(\s*f["\']"""),
        (4, "HIGH", "os.popen with User Input",
         r"""os\.popen\s*\([^)]*\+|os\.popen\s*\(f["\']"""),
        (5, "HIGH", "Deprecated commands Module",
         r"""commands\.(getoutput|getstatusoutput)"""),
    ]),
    ("CMD", "JAVA"): (False, [
        (1, "CRITICAL", "Runtime.exec() with Concatenation",
         r"""Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+"""),
        (2, "MEDIUM", "ProcessBuilder with Single String",
         r"""new\s+ProcessBuilder\s*\(\s*["\']"""),
    ]),
    ("CMD", "RB"): (False, [
        (1, "CRITICAL", "system() with String Interpolation",
         r"""system\s*\([^)]*#\{"""),
        (2, "CRITICAL", "Backtick Command with Interpolation",
         r"""`[^`]*#\{"""),
        (3, "CRITICAL", "exec() with String Interpolation",
         r"""exec\s*\([^)]*#\{"""),
    ]),
    ("TRAV", "PHP"): (True, [
        (1, "CRITICAL", "Include/Require with User Input",
         r"""(include|require|include_once|require_once)\s*\(?[^;)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$_SERVER\[["\']PHP_SELF)"""),
        (2, "HIGH", "file_get_contents with User Input",
         r"""file_get_contents\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (3, "CRITICAL", "file_put_contents with User Input",
         r"""file_put_contents\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (4, "HIGH", "fopen with User Input",
         r"""fopen\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (5, "HIGH", "readfile with User Input",
         r"""readfile\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (6, "CRITICAL", "unlink with User Input",
         r"""unlink\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (7, "HIGH", "File Operation with User Input",
         r"""(copy|rename)\s*\([^)]*(\$_GET|\$_POST|\$_REQUEST|\$_COOKIE)"""),
        (8, "MEDIUM", "Directory Traversal Pattern Detected",
         r"""\.\./|\.\.\\\\"""),
        (9, "MEDIUM", "File Path String Concatenation",
         r"""(file_get_contents|fopen|readfile|include|require)\s*\([^)]*\.\s*\$"""),
    ]),
    ("TRAV", "JS"): (False, [
        (1, "HIGH", "fs.readFile with User Input",
         r"""fs\.(readFile|readFileSync)\s*\([^)]*req\.(query|body|params)"""),
        (2, "CRITICAL", "fs.writeFile with User Input",
         r"""fs\.(writeFile|writeFileSync)\s*\([^)]*req\.(query|body|params)"""),
        (3, "HIGH", "res.sendFile with User Input",
         r"""res\.sendFile\s*\([^)]*req\.(query|body|params)"""),
        (4, "CRITICAL", "File Deletion with User Input",
         r"""fs\.(unlink|unlinkSync|rm|rmSync)\s*\([^)]*req\.(query|body|params)"""),
        (5, "CRITICAL", "require() with User Input",
         r"""require\s*\([^)]*req\.(query|body|params)"""),
        (6, "HIGH", "File Operation with Template Literal User Input",
         r"""(readFile|writeFile|sendFile|unlink)\s*\(\s*`[^`]*\$\{[^}]*req\."""),
        (7, "HIGH", "File Path Concatenation with User Input",
         r"""(readFile|writeFile|sendFile|require)\s*\([^)]*\+[^)]*req\."""),
        (8, "MEDIUM", "Directory Traversal Pattern Detected",
         r"""\.\./|\.\.\\\\"""),
    ]),
    ("TRAV", "PY"): (False, [
        (1, "HIGH", "open() with User Input",
         r"""open\s*\([^)]*request\.(args|form|values|json|data)"""),
        (2, "HIGH", "Path() with User Input",
         r"""Path\s*\([^)]*request\.(args|form|values|json|data)"""),
        (3, "HIGH", "send_file with User Input",
         r"""send_file\s*\([^)]*request\.(args|form|values|json|data)"""),
        (4, "CRITICAL", "File Deletion with User Input",
         r"""os\.(remove|unlink)\s*\([^)]*request\.(args|form|values|json|data)"""),
        (5, "CRITICAL", "File Operation with User Input",
         r"""shutil\.(copy|move|rmtree)\s*\([^)]*request\.(args|form|values|json|data)"""),
        (6, "CRITICAL", "__import__ with User Input",
         r"""__import__\s*\([^)]*request\."""),
        (7, "HIGH", "File Path with F-String User Input",
         r"""open\s*\(\s*f["\'][^"\']*\{[^}]*request\."""),
        (8, "HIGH", "File Path Concatenation with User Input",
         r"""open\s*\([^)]*\+[^)]*request\."""),
        (9, "MEDIUM", "Directory Traversal Pattern Detected",
         r"""\.\./|\.\.\\\\"""),
    ]),
    ("TRAV", "JAVA"): (False, [
        (1, "HIGH", "File() with User Input",
         r"""new\s+File\s*\([^)]*request\.(getParameter|getHeader)"""),
        (2, "HIGH", "File Stream with User Input",
         r"""new\s+File(Input|Output)Stream\s*\([^)]*request\.(getParameter|getHeader)"""),
        (3, "HIGH", "Files Operation with User Input",
         r"""Files\.(readAllBytes|readString|write|delete)\s*\([^)]*request\."""),
        (4, "MEDIUM", "Directory Traversal Pattern Detected",
         r"""\.\./|\.\.\\\\"""),
    ]),
    ("TRAV", "RB"): (False, [
        (1, "HIGH", "File Operation with User Input",
         r"""File\.(open|read|write|delete)\s*\([^)]*params\["""),
        (2, "HIGH", "send_file with User Input",
         r"""send_file\s*\([^)]*params\["""),
        (3, "MEDIUM", "Directory Traversal Pattern Detected",
         r"""\.\./|\.\.\\\\"""),
    ]),
    ("TRAV", "GO"): (False, [
        (1, "HIGH", "File Operation with User Input",
         r"""os\.(Open|Create|Remove)\s*\([^)]*r\.(URL\.Query|FormValue|PostFormValue)"""),
        (2, "HIGH", "File Read/Write with User Input",
         r"""(ioutil|os)\.(ReadFile|WriteFile)\s*\([^)]*r\.(URL\.Query|FormValue|PostFormValue)"""),
        (3, "MEDIUM", "Directory Traversal Pattern Detected",
         r"""\.\./|\.\.\\\\"""),
    ]),
}
# fmt: on
