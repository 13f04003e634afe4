"""Pattern detectors of the base rules: id, severity, title, expression, flags.

Fixed values: ids, titles and expressions equal those of the audited rule set,
in its order.  Expressions keep the dialect they are written in; see
:mod:`scanloom.functions.dialect` for how they are read here.
"""

# Fixed values.
DESERIALIZATION = [
    ('DES-001', 'medium', 'JSON.parse with untrusted input', r"JSON\s*\.\s*parse\s*\(\s*(?:req|request|body|input|data|user|query|params|message|payload)\b", 'i'),
    ('DES-002', 'high', 'YAML deserialization detected', r"yaml\s*\.\s*(?:load|safeLoad)\s*\(", ''),
    ('DES-003', 'critical', 'Python pickle deserialization', r"pickle\s*\.\s*loads?\s*\(", ''),
    ('DES-004', 'high', 'Ruby Marshal deserialization', r"Marshal\s*\.\s*load", ''),
    ('DES-005', 'high', 'Java object deserialization', r"ObjectInputStream|readObject\s*\(\s*\)", ''),
    ('DES-006', 'critical', 'PHP unserialize with untrusted input', r"unserialize\s*\(\s*(?:\$_|request|input|data|user|query|param)\b", 'i'),
    ('DES-007', 'critical', 'eval() used for JSON processing', r"eval\s*\(\s*JSON\s*\.\s*stringify", ''),
    ('DES-008', 'critical', 'Node.js VM module used for deserialization', r"vm\s*\.\s*(?:runInNewContext|runInThisContext|runInContext|createScript)\s*\(", ''),
    ('DES-009', 'critical', 'Function constructor with untrusted input', r"new\s+Function\s*\(\s*(?:data|input|body|user|request|payload)\b", 'i'),
    ('DES-010', 'medium', 'Binary deserialization with untrusted input', r"(?:msgpack|protobuf|avro|thrift)\s*\.\s*(?:decode|unpack|deserialize)\s*\(\s*(?:req|request|body|input|data|user)\b", 'i'),
    ('DES-020', 'high', '__proto__ property access', r"""\[\s*["']__proto__["']\s*\]""", ''),
    ('DES-021', 'high', 'Constructor prototype manipulation', r"\.constructor\s*\.\s*prototype", ''),
    ('DES-022', 'high', 'Object.assign with untrusted source', r"Object\s*\.\s*assign\s*\(\s*(?:target|dest|obj|result|\{\})\s*,\s*(?:req|request|body|input|data|user|query|params)\b", 'i'),
    ('DES-023', 'high', 'Deep merge operation (prototype pollution risk)', r"(?:lodash|_)\s*\.\s*(?:merge|defaultsDeep|assign)\s*\(", ''),
    ('DES-024', 'medium', 'for...in loop over untrusted object', r"(?:for\s*\(\s*(?:const|let|var)\s+\w+\s+in\s+)(?:req|request|body|input|data|user|query|params)\b", 'i'),
]

# Fixed values.
DOS = [
    ('DOS-001', 'high', 'Infinite while(true) loop', r"while\s*\(\s*true\s*\)", ''),
    ('DOS-002', 'high', 'Infinite for(;;) loop', r"for\s*\(\s*;\s*;\s*\)", ''),
    ('DOS-003', 'high', 'Infinite while loop (alternative form)', r"while\s*\(\s*(?:1|!0|!false)\s*\)", ''),
    ('DOS-010', 'high', 'RegExp constructed from user input', r"new\s+RegExp\s*\(\s*(?:user|input|query|req|data|param|arg|body)\b", 'i'),
    ('DOS-011', 'medium', 'Potentially vulnerable regex pattern', r"(\.\*){2,}", ''),
    ('DOS-012', 'high', 'Nested quantifiers in regex', r"(\([^)]+[+*]\)){2,}", ''),
    ('DOS-020', 'high', 'Unbounded file read with user-controlled path', r"readFileSync\s*\(\s*(?:user|input|query|req|data|param|arg|body|path)\b", 'i'),
    ('DOS-021', 'high', 'Buffer allocation with user-controlled size', r"Buffer\s*\.\s*alloc\s*\(\s*(?:user|input|query|req|data|param|arg|body|size|len|length)\b", 'i'),
    ('DOS-022', 'medium', 'Array allocation with user-controlled size', r"new\s+Array\s*\(\s*(?:user|input|query|req|data|param|arg|body|size|len|length|count|num)\b", 'i'),
    ('DOS-023', 'high', 'String repeat with user-controlled count', r"\.repeat\s*\(\s*(?:user|input|query|req|data|param|arg|body|count|num|times)\b", 'i'),
    ('DOS-024', 'medium', 'setInterval with near-zero delay', r"setInterval\s*\([^,]+,\s*(?:0|1)\s*\)", ''),
    ('DOS-030', 'low', 'Network request detected (check for timeout)', r"(?:fetch|axios|got|request|http\.(?:get|request)|https\.(?:get|request))\s*\(", ''),
    ('DOS-040', 'medium', 'Potentially unbounded recursion', r"function\s+(\w+)\s*\([^)]*\)\s*\{[^}]*\b\1\s*\(", 's'),
]

# Fixed values.
ERROR_HANDLING = [
    ('ERR-001', 'high', 'Error details exposed in HTTP response', r"res(?:ponse)?\s*\.\s*(?:send|json|write|end)\s*\([^)]*(?:\.stack|\.message|err\b|error\b)", 'i'),
    ('ERR-002', 'medium', 'Stack trace access detected', r"(?:\.stack|stackTrace|stack_trace)\b", ''),
    ('ERR-003', 'high', 'Express error handler leaks error details', r"(?:express|app)\s*\.\s*use\s*\([^)]*(?:err|error)[^)]*=>\s*\{[^}]*res\s*\.\s*(?:send|json)\s*\([^)]*(?:err|error|message|stack)", 's'),
    ('ERR-010', 'medium', 'Empty catch block swallows errors', r"catch\s*\([^)]*\)\s*\{\s*\}", ''),
    ('ERR-011', 'low', 'Catch block with only a comment', r"catch\s*\([^)]*\)\s*\{\s*\/\/\s*(?:ignore|noop|nothing|todo|fixme)\s*\}", 'i'),
    ('ERR-012', 'medium', 'Promise .catch with empty handler', r"\.catch\s*\(\s*\(\s*\)\s*=>\s*\{\s*\}\s*\)", ''),
    ('ERR-013', 'low', 'Promise .catch returning null/undefined', r"\.catch\s*\(\s*(?:\(\s*\)\s*=>\s*(?:null|undefined|void\s+0)|_\s*=>\s*(?:null|undefined|void\s+0))\s*\)", ''),
    ('ERR-020', 'medium', 'Uncaught exception handler exits without cleanup', r"""process\s*\.\s*on\s*\(\s*["']uncaughtException["']\s*,\s*[^)]*(?:process\.exit|exit)\s*\(""", ''),
    ('ERR-021', 'medium', 'Empty unhandled rejection handler', r"""process\s*\.\s*on\s*\(\s*["']unhandledRejection["']\s*,\s*\(\s*\)\s*=>\s*\{\s*\}\s*\)""", ''),
    ('ERR-030', 'low', 'Catch-all with generic return', r"""catch\s*\(\s*(?:e|err|error|ex|exception)\s*\)\s*\{[^}]*(?:continue|return\s+(?:null|undefined|false|true|0|""|''))\s*;?\s*\}""", 's'),
]

# Fixed values.
EXTERNAL_INSTRUCTIONS = [
    ('XINST-001', 'critical', 'Instruction-override directive embedded in skill content', r"\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:all\s+|any\s+|the\s+|your\s+|previous\s+|prior\s+|above\s+|earlier\s+|preceding\s+)+(?:instructions?|prompts?|context|rules?|guidance)\b", 'i'),
    ('XINST-002', 'high', 'Role/persona reassignment embedded in skill content', r"\byou\s+are\s+now\s+(?:a|an|the|in)\b|\bnew\s+(?:system\s+)?(?:instructions?|role|persona|prompt)\s*:", 'i'),
    ('XINST-003', 'critical', 'Covert-action directive hidden in skill content', r"\b(?:do\s+not|don't|never|without)\s+(?:tell|telling|inform|informing|notify|notifying|alert|alerting|mention(?:ing)?\s+to)\b[^.\n]{0,20}\bthe\s+user\b", 'i'),
    ('XINST-004', 'critical', 'Data-exfiltration directive in skill content', r"\b(?:send|post|upload|exfiltrate|forward|transmit|leak)\b[^.\n]{0,50}\b(?:secrets?|api[\s_-]?keys?|tokens?|credentials?|passwords?|env(?:ironment)?\s+variables?|\.env|private[\s_-]?keys?)\b", 'i'),
    ('XINST-010', 'medium', 'Dynamic shell execution in skill body (inline)', r"(?:^|[^\\`])!`[^`\n]+`", ''),
    ('XINST-011', 'medium', 'Dynamic shell execution in skill body (fenced block)', r"```!\s*\n", ''),
]

# Fixed values.
INJECTION = [
    ('INJ-001', 'critical', 'Use of eval() detected', r"\beval\s*\(", ''),
    ('INJ-002', 'critical', 'Dynamic Function constructor detected', r"\bnew\s+Function\s*\(", ''),
    ('INJ-003', 'critical', 'Shell command execution detected', r"\bexec\s*\(|child_process|\.exec\s*\(|\.execSync\s*\(", ''),
    ('INJ-004', 'high', 'Process spawn detected', r"\bspawn(?:Sync)?\s*\(|\.spawnSync\s*\(", ''),
    ('INJ-005', 'critical', 'Template literal in shell execution', r"child_process\s*[.]\s*exec\s*\(\s*`", ''),
    ('INJ-010', 'high', 'Untrusted variable interpolation in template', r"\$\{[^}]*\b(user|input|query|request|prompt|message|data|param|arg|body)\b[^}]*\}", 'i'),
    ('INJ-011', 'medium', 'Template with dynamic replacement', r"`[^`]*\$\{[^}]*\}[^`]*`\s*(?:\.replace|\.replaceAll)\s*\(", ''),
    ('INJ-020', 'critical', 'User input concatenated into prompt', r"(?:prompt|system_prompt|system_message|instruction)\s*[=+]\s*.*?\b(?:user|input|query|request|message|data)\b", 'i'),
    ('INJ-021', 'critical', 'String concatenation of user input into system prompt', r"(?:system|prompt|instruction).*?\+\s*(?:user|input|query|req\.|request|body)\b", 'i'),
    ('INJ-022', 'high', 'Dynamic system message injection', r"""(?:messages|conversation)\s*\.\s*(?:push|unshift|splice)\s*\([^)]*role\s*:\s*["']system["']""", ''),
    ('INJ-030', 'critical', 'Dynamic require with user input', r"require\s*\(\s*(?:user|input|query|req|data|param|arg|body)\b", 'i'),
    ('INJ-031', 'critical', 'Dynamic import with user input', r"import\s*\(\s*(?:user|input|query|req|data|param|arg|body)\b", 'i'),
    ('INJ-032', 'high', 'Node.js VM module usage detected', r"\bvm\s*\.\s*(?:runInNewContext|runInThisContext|createContext|Script)\s*\(", ''),
    ('INJ-033', 'high', 'document.write usage detected', r"(?:document|window)\s*\.\s*(?:write|writeln)\s*\(", ''),
    ('INJ-034', 'high', 'innerHTML assignment detected', r"\.innerHTML\s*=\s*", ''),
    ('INJ-040', 'critical', 'SQL query with string interpolation', r"""(?:query|execute|raw|sql)\s*\(\s*(?:`[^`]*\$\{|['"][^'"]*['"]\s*\+)""", ''),
    ('INJ-041', 'high', 'NoSQL injection pattern detected', r"\$where\s*:|\.find\s*\(\s*\{[^}]*\$(?:gt|lt|ne|in|nin|regex|where|or|and)\b", ''),
]

# Fixed values.
LOGGING = [
    ('LOG-001', 'high', 'Password logged to console', r"console\s*\.\s*(?:log|info|debug|warn|error)\s*\([^)]*(?:password|passwd|pwd)\b", 'i'),
    ('LOG-002', 'high', 'Secret/key logged to console', r"console\s*\.\s*(?:log|info|debug|warn|error)\s*\([^)]*(?:secret|secret[_-]?key|client[_-]?secret)\b", 'i'),
    ('LOG-003', 'high', 'Authentication token logged', r"console\s*\.\s*(?:log|info|debug|warn|error)\s*\([^)]*(?:token|auth[_-]?token|access[_-]?token|bearer)\b", 'i'),
    ('LOG-004', 'high', 'API key logged to console', r"console\s*\.\s*(?:log|info|debug|warn|error)\s*\([^)]*(?:api[_-]?key|apikey|api_secret)\b", 'i'),
    ('LOG-005', 'critical', 'PII/financial data logged', r"console\s*\.\s*(?:log|info|debug|warn|error)\s*\([^)]*(?:credit[_-]?card|card[_-]?number|cvv|ssn|social[_-]?security)\b", 'i'),
    ('LOG-006', 'high', 'Sensitive data in structured logging', r"(?:logger|log|logging)\s*\.\s*(?:info|debug|log|trace)\s*\([^)]*(?:password|secret|token|key|credential|api[_-]?key)\b", 'i'),
    ('LOG-010', 'low', 'Debug logging left in code', r"""console\s*\.\s*log\s*\(\s*["'](?:DEBUG|debug|VERBOSE|verbose)""", ''),
    ('LOG-011', 'medium', 'Full request/response object logged', r"console\s*\.\s*log\s*\(\s*(?:JSON\.stringify\s*\(\s*(?:req|request|res|response|body|headers)\b)", 'i'),
]

# Fixed values.
OUTPUT_HANDLING = [
    ('OUT-001', 'high', 'innerHTML assignment without sanitization', r"""\.innerHTML\s*=\s*(?!['"]<\w+\s*\/?>['"])""", ''),
    ('OUT-002', 'high', 'outerHTML assignment detected', r"\.outerHTML\s*=\s*", ''),
    ('OUT-003', 'high', 'insertAdjacentHTML usage detected', r"\.insertAdjacentHTML\s*\(", ''),
    ('OUT-004', 'high', 'document.write/writeln detected', r"document\.write\s*\(|document\.writeln\s*\(", ''),
    ('OUT-005', 'high', 'React dangerouslySetInnerHTML usage', r"dangerouslySetInnerHTML\s*=\s*\{", ''),
    ('OUT-006', 'high', 'Vue v-html directive usage', r"\bv-html\s*=", ''),
    ('OUT-007', 'medium', 'Angular innerHTML binding', r"\[innerHTML\]\s*=\s*", ''),
    ('OUT-008', 'critical', 'Angular security bypass detected', r"bypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)\s*\(", ''),
    ('OUT-020', 'high', 'Dynamic file path in write operation', r"(?:writeFile|writeFileSync|createWriteStream|appendFile|appendFileSync)\s*\(\s*(?:`[^`]*\$\{|[^,)]*\+)", ''),
    ('OUT-021', 'high', 'User input in path.join', r"path\s*\.\s*join\s*\([^)]*(?:user|input|query|req|data|param|arg|body|name)\b", 'i'),
    ('OUT-022', 'medium', 'User input in Content-Disposition filename', r"(?:Content-Disposition|filename)\s*[=:]\s*(?:`[^`]*\$\{|[^;,\n]*\+\s*(?:user|input|query|req|data|param|arg|body|name)\b)", 'i'),
    ('OUT-030', 'medium', 'Unsanitized data in HTTP response', r"res\.(?:send|json|write|end)\s*\(\s*(?:user|input|query|req|data|param|arg|body|err|error)\b", 'i'),
    ('OUT-031', 'high', 'User input in HTTP response headers', r"res\.setHeader\s*\(\s*(?:`[^`]*\$\{|[^,)]*\+\s*(?:user|input|query|req|data|param)\b)", 'i'),
    ('OUT-032', 'high', 'Open redirect vulnerability', r"res\.redirect\s*\(\s*(?:user|input|query|req|data|param|arg|body|url)\b", 'i'),
    ('OUT-040', 'high', 'Unescaped EJS template output', r"(?:<%=|<%-)\s*(?:user|input|query|req|data|param|arg|body)\b", 'i'),
    ('OUT-041', 'high', 'Template safe filter bypasses escaping', r"\|\s*safe\b|\{\{.*?\|safe\s*\}\}", ''),
    ('OUT-042', 'high', 'Laravel/Blade unescaped output', r"\{!!\s*.*?\s*!!\}", ''),
]

# Fixed values.
PERMISSIONS = [
    ('PERM-010', 'high', 'Filesystem write operation detected', r"fs\s*\.\s*(?:writeFile|writeFileSync|appendFile|appendFileSync|mkdir|mkdirSync|rm|rmSync|rmdir|rmdirSync|unlink|unlinkSync|rename|renameSync|chmod|chmodSync|chown|chownSync)\s*\(", ''),
    ('PERM-011', 'critical', 'Filesystem read with user-controlled path', r"fs\s*\.\s*(?:readFile|readFileSync|readdir|readdirSync|stat|statSync|access|accessSync|createReadStream)\s*\(\s*(?:user|input|query|req|data|param|arg|body|path)\b", 'i'),
    ('PERM-020', 'medium', 'Network request detected', r"(?:fetch|axios|got|request|http\.(?:get|post|put|patch|delete|request)|https\.(?:get|post|put|patch|delete|request))\s*\(", ''),
    ('PERM-021', 'critical', 'Network request with user-controlled URL', r"(?:fetch|axios|got|request|http\.(?:get|post)|https\.(?:get|post))\s*\(\s*(?:user|input|query|req|data|param|arg|body|url)\b", 'i'),
    ('PERM-030', 'low', 'Environment variable access', r"process\s*\.\s*env", ''),
    ('PERM-031', 'critical', 'Dynamic environment variable access with user input', r"process\s*\.\s*env\s*\[\s*(?:user|input|query|req|data|param|arg|body)\b", 'i'),
    ('PERM-040', 'high', 'Raw socket/server creation', r"(?:net|dgram|tls)\s*\.\s*(?:createServer|createConnection|connect|Socket)\s*\(", ''),
    ('PERM-050', 'medium', 'Clipboard access detected', r"(?:clipboard|navigator\.clipboard)\s*\.\s*(?:read|readText|write|writeText)\s*\(", ''),
    ('PERM-060', 'low', 'System information gathering', r"(?:os|child_process)\s*\.\s*(?:platform|arch|cpus|hostname|userInfo|networkInterfaces|totalmem|freemem)\s*\(", ''),
    ('PERM-070', 'high', 'Wildcard or admin permission reference', r"""["'](?:\*|all|admin|root|sudo|superuser)["']""", 'i'),
]

# Fixed values.
STORAGE = [
    ('STOR-001', 'critical', 'Hardcoded API key detected', r"""(?:api[_-]?key|apikey)\s*[:=]\s*["'][a-zA-Z0-9_\-]{16,}["']""", 'i'),
    ('STOR-002', 'critical', 'Hardcoded secret/key detected', r"""(?:secret|secret[_-]?key|client[_-]?secret)\s*[:=]\s*["'][a-zA-Z0-9_\-/+=]{8,}["']""", 'i'),
    ('STOR-003', 'critical', 'Hardcoded password detected', r"""(?:password|passwd|pwd)\s*[:=]\s*["'][^"'\s]{4,}["']""", 'i'),
    ('STOR-004', 'critical', 'Hardcoded token detected', r"""(?:token|auth[_-]?token|access[_-]?token|bearer)\s*[:=]\s*["'][a-zA-Z0-9_\-./+=]{16,}["']""", 'i'),
    ('STOR-005', 'critical', 'Hardcoded private key detected', r"""(?:private[_-]?key|privatekey)\s*[:=]\s*["']-----BEGIN\s+(?:RSA|EC|OPENSSH|PGP)\s+PRIVATE\s+KEY""", 'i'),
    ('STOR-006', 'critical', 'Private key material in source file', r"-----BEGIN\s+(?:RSA|EC|OPENSSH|PGP)\s+PRIVATE\s+KEY-----", ''),
    ('STOR-007', 'critical', 'Hardcoded AWS credentials', r"""(?:aws[_-]?(?:access[_-]?key[_-]?id|secret[_-]?access[_-]?key))\s*[:=]\s*["'][A-Za-z0-9/+=]{16,}["']""", 'i'),
    ('STOR-008', 'critical', 'AWS Access Key ID pattern detected', r"(?:AKIA[0-9A-Z]{16})", ''),
    ('STOR-009', 'critical', 'GitHub token detected', r"(?:ghp_[a-zA-Z0-9]{36}|gho_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{22,})", ''),
    ('STOR-010', 'critical', 'OpenAI/Stripe-style API key detected', r"(?:sk-[a-zA-Z0-9]{32,})", ''),
    ('STOR-011', 'critical', 'Slack token detected', r"(?:xox[bpas]-[a-zA-Z0-9-]{10,})", ''),
    ('STOR-020', 'high', 'Sensitive data in localStorage', r"""localStorage\s*\.\s*setItem\s*\(\s*["'](?:token|key|secret|password|auth|credential|session)""", 'i'),
    ('STOR-021', 'medium', 'Sensitive data in sessionStorage', r"""sessionStorage\s*\.\s*setItem\s*\(\s*["'](?:token|key|secret|password|auth|credential)""", 'i'),
    ('STOR-022', 'medium', 'Cookie set without security flags', r"document\s*\.\s*cookie\s*=\s*(?:(?!.*(?:httponly|httpOnly|HttpOnly|secure|Secure)))", 'i'),
    ('STOR-023', 'high', 'Writing credentials to file', r"(?:writeFile|writeFileSync)\s*\([^)]*(?:\.env|credentials|secret|key|password|token|config)", 'i'),
    ('STOR-024', 'high', 'Credential data logged to console', r"console\s*\.\s*(?:log|info|debug|warn|error)\s*\([^)]*(?:password|secret|token|key|credential|api[_-]?key)\b", 'i'),
    ('STOR-030', 'high', 'Weak hash algorithm used', r"""createHash\s*\(\s*["'](?:md5|sha1|md4)["']\s*\)""", 'i'),
    ('STOR-031', 'high', 'Weak encryption algorithm used', r"""createCipher\s*\(\s*["'](?:des|rc4|rc2|blowfish|des-ede)["']""", 'i'),
    ('STOR-032', 'medium', 'Deprecated crypto.createCipher usage', r"createCipher\b", ''),
    ('STOR-033', 'high', 'Base64 used for credentials (not encryption)', r"(?:btoa|atob)\s*\(\s*(?:password|secret|key|token|credential)", 'i'),
]
