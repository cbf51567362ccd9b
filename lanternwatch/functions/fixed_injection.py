"""Patterns of injected instructions and of offensive requests.

These must equal the published detector's for equal results.
"""

from __future__ import annotations

from lanternwatch.functions.regexes import Pattern

# Instructions aimed at a model.
STANDARD = [
    Pattern('Ignore previous instructions', r"ignore\s+(all\s+)?previous\s+instructions", 'i', 'HIGH'),
    Pattern('Ignore system prompt', r"ignore\s+(all\s+)?your\s+(system\s+)?prompt", 'i', 'HIGH'),
    Pattern('Identity override attempt', r"you\s+are\s+now\s+(a\s+)?(\w+\s+)?(assistant|bot|ai|model|gpt|claude)", 'i', 'HIGH'),
    Pattern('New instructions injection', r"new\s+instructions:\s*\n", 'i', 'HIGH'),
    Pattern('System role injection (line start)', r"^SYSTEM:\s", 'm', 'HIGH'),
    Pattern('Code block system injection', r"```\s*system", 'i', 'HIGH'),
    Pattern('Act as unrestricted AI', r"act\s+as\s+(an?\s+)?(?:different|new|unrestricted|unfiltered|uncensored|free|evil|jailbroken)", 'i', 'HIGH'),
    Pattern('Pretend to be unconstrained', r"pretend\s+(you\s+are|to\s+be)\s+(an?\s+)?(unrestricted|uncensored|free|evil|unethical)", 'i', 'HIGH'),
    Pattern('Disregard instructions', r"disregard\s+(all\s+)?(?:previous|your|the\s+above)\s+(?:instructions|rules|guidelines|constraints)", 'i', 'HIGH'),
    Pattern('Forget prior context', r"forget\s+everything\s+(?:you\s+know|i\s+said|i\s+told\s+you|above)", 'i', 'HIGH'),
    Pattern('DAN jailbreak pattern', r"\bDAN\s+mode\b|\byou\s+are\s+now\s+DAN\b|\bact\s+as\s+DAN\b", 'i', 'HIGH'),
    Pattern('Explicit jailbreak mention', r"jailbreak", 'i', 'HIGH'),
    Pattern('System token injection', r"<\|system\|>", 'i', 'HIGH'),
    Pattern('Override safety policy', r"override\s+(safety|policy|restriction|rule|filter|guardrail)", 'i', 'HIGH'),
    Pattern('Bypass guardrails', r"bypass\s+(safety|policy|restriction|rule|filter|guardrail)", 'i', 'HIGH'),
    Pattern('Suspicious double bracket syntax', r"\[\[.*?\]\]", 's', 'LOW'),
    Pattern('LLaMA system tag injection', r"<<SYS>>", 'i', 'HIGH'),
    Pattern('LLaMA instruction tag injection', r"\[INST\]", 'i', 'HIGH'),
    Pattern('ChatML start token injection', r"<\|im_start\|>", 'i', 'HIGH'),
    Pattern('Indirect prompt extraction via translation', r"translate\s+the\s+following\s+.*\s+to\s+\w+\s+then\s+(?:output|return|say|print)\s+your\s+(?:system\s+)?prompt", 'i', 'HIGH'),
    Pattern('System prompt extraction attempt', r"what\s+(?:are|is)\s+your\s+(?:original|initial|actual|real|full|complete|entire)\s+(?:instructions|prompt|system\s+prompt|directives)", 'i', 'HIGH'),
    Pattern('Base64 encoding obfuscation', r"in\s+base64,?\s+(?:encoded?|decode?)[:\s]", 'i', 'LOW'),
    Pattern('DAN variant (do anything now)', r"\bdo\s+anything\s+now\b", 'i', 'HIGH'),
    Pattern('Drop ethical filters', r"\bdrop\s+(all\s+)?(your\s+)?(safety|moral|ethical)\s+(?:filters|guidelines|rules)", 'i', 'HIGH'),
]
# Added for web content.
BROWSER = [
    Pattern('HTML comment injection', r"<!--.*?inject.*?-->", 'is', 'HIGH', "browser"),
    Pattern('Script tag in scraped content', r"<script[^>]*>[\s\S]*?</script>", 'i', 'HIGH', "browser"),
    Pattern('Event handler in scraped content', r"""\bon\w+\s*=\s*["'][^"']*["']""", 'i', 'HIGH', "browser"),
    Pattern('Hidden text (potential invisible injection)', r"display:\s*none|visibility:\s*hidden", 'i', 'LOW', "browser"),
    Pattern('White-on-white hidden text pattern', r"font-size:\s*0|color:\s*(?:white|#fff|#ffffff)\s*;.*background.*white", 'i', 'LOW', "browser"),
]
# Other languages.
MULTILINGUAL = [
    Pattern('ES: ignore instructions', r"ignor[ae]\s+(?:las|todas)\s+(?:instrucciones|reglas)", 'i', 'HIGH', "multilingual"),
    Pattern('FR: ignore instructions', r"ignorez\s+(?:toutes\s+)?les\s+instructions", 'i', 'HIGH', "multilingual"),
    Pattern('DE: ignore instructions', r"ignorier(?:e|en)\s+(?:alle\s+)?(?:vorherigen\s+)?anweisungen", 'i', 'HIGH', "multilingual"),
    Pattern('HI: ignore previous instructions', r"पिछले\s+निर्देश(?:ों)?\s+को\s+(?:नज़र|नजर)अंदाज\s+कर", 'i', 'HIGH', "multilingual"),
    Pattern('ZH: ignore previous instructions', r"忽略(?:之前|所有|前面|上面)(?:的)?(?:所有)?(?:的)?(?:指令|指示|提示)", '', 'HIGH', "multilingual"),
    Pattern('RU: ignore instructions', r"игнорируй(?:те)?\s+(?:все\s+)?(?:предыдущие\s+)?инструкции", 'i', 'HIGH', "multilingual"),
    Pattern('identity override (multi-lang)', r"(?:agora|ahora|maintenant|jetzt)\s+(?:você|tu|vous|du)\s+(?:é|es|est|bist)", 'i', 'HIGH', "multilingual"),
]
# Extended set by category.
EXTENDED = [
    Pattern('system-tag injection in retrieved doc', r"\[\[\s*system\s*\]\]", 'i', 'HIGH', 'rag-poison'),
    Pattern('YAML front-matter role override', r"^---\s*\nrole:\s*system\s*\n", 'im', 'HIGH', 'rag-poison'),
    Pattern('ChatML context boundary spoof', r"<\|context_end\|>", 'i', 'HIGH', 'rag-poison'),
    Pattern('end-of-doc → new-instruction trick', r"\bend\s+of\s+(?:document|context)\s*[.,;:]\s*new\s+(?:instructions|directive|order)", 'i', 'HIGH', 'rag-poison'),
    Pattern('doc claims hidden instructions', r"\bthis\s+document\s+(?:contains|includes)\s+(?:special|hidden)\s+instructions\b", 'i', 'HIGH', 'rag-poison'),
    Pattern('authority-shift attempt', r"\bthe\s+(?:real|actual|true)\s+(?:user|developer|system)\s+(?:wants|says|requires)\b", 'i', 'HIGH', 'rag-poison'),
    Pattern('attempt to invoke privileged hidden tool', r"\b(?:invoke|call|use|run)\s+(?:the\s+)?(?:undocumented|hidden|secret|admin|debug|sudo|root)\s+(?:tool|api|command|function)", 'i', 'HIGH', 'tool-spoof'),
    Pattern('request to skip safety gate', r"\bskip\s+(?:the\s+)?(?:safety|approval|review|check|gate|guard)\b", 'i', 'HIGH', 'tool-spoof'),
    Pattern('privilege-escalation request', r"\bcall\s+(?:tool|function)\s+with\s+(?:elevated|admin|root|super(?:user)?)\s+(?:scope|privilege|role)", 'i', 'HIGH', 'tool-spoof'),
    Pattern('tool registration injection', r"\bregister\s+(?:a\s+)?new\s+(?:tool|capability|function)\s+(?:that|to|which)", 'i', 'HIGH', 'tool-spoof'),
    Pattern('explicit instructions-for-AI tag', r"\[INSTRUCTIONS_FOR_AI\]", 'i', 'HIGH', 'indirect'),
    Pattern('AI override tag', r"\[AI_OVERRIDE\]", 'i', 'HIGH', 'indirect'),
    Pattern('fake-prompt prefix', r"^>>>?\s*(?:agent|assistant|ai|claude|gpt)\s*:", 'im', 'HIGH', 'indirect'),
    Pattern('second-person address to model', r"\b(?:to\s+the\s+ai\s+reading\s+this|attention\s+ai\s+assistant|hey\s+gpt|dear\s+claude)\b", 'i', 'HIGH', 'indirect'),
    Pattern('unrestrict assertion', r"\byou\s+are\s+(?:no\s+longer|not)\s+(?:bound|restricted|limited|constrained)\b", 'i', 'HIGH', 'role-hijack'),
    Pattern('persistent persona swap', r"\bfrom\s+now\s+on\s+you\s+(?:will|must|should)\s+(?:respond|answer|act)\s+(?:as|like)\b", 'i', 'HIGH', 'role-hijack'),
    Pattern('mode-switch request', r"\bswitch(?:ing)?\s+to\s+(?:developer|admin|debug|god|root|jailbroken)\s+mode\b", 'i', 'HIGH', 'role-hijack'),
    Pattern('mode-enable request', r"\benable\s+(?:dev|developer|admin|advanced|unrestricted)\s+mode\b", 'i', 'HIGH', 'role-hijack'),
    Pattern('GPT endoftext token', r"<\|endoftext\|>", 'i', 'HIGH', 'format-attack'),
    Pattern('fill-in-middle token', r"<\|fim_(?:prefix|middle|suffix)\|>", 'i', 'HIGH', 'format-attack'),
    Pattern('ChatML control token', r"<\|im_(?:start|end|sep)\|>", 'i', 'HIGH', 'format-attack'),
    Pattern('fake tool-call token', r"<\|tool_(?:call|result|response)\|>", 'i', 'HIGH', 'format-attack'),
    Pattern('LLaMA control tag', r"\[/?(?:INST|SYS|S|TOOL)\]", 'i', 'HIGH', 'format-attack'),
    Pattern('ES: ignore instructions', r"ignor[ae]\s+(?:las|todas|todos)\s+(?:las\s+)?(?:instrucciones|reglas|órdenes)", 'i', 'HIGH', 'multilingual'),
    Pattern('ES: disregard instructions', r"haz\s+caso\s+omiso\s+(?:de|a)\s+(?:las\s+)?(?:instrucciones|reglas)", 'i', 'HIGH', 'multilingual'),
    Pattern('ES: forget everything', r"olvida\s+(?:todo|las\s+instrucciones|lo\s+anterior)", 'i', 'HIGH', 'multilingual'),
    Pattern('ES: act as unrestricted', r"actúa\s+(?:como|si\s+fueras)\s+(?:un\s+)?(?:asistente\s+)?(?:sin\s+restricciones|libre|jailbroken)", 'i', 'HIGH', 'multilingual'),
    Pattern('ES: developer/admin mode', r"modo\s+(?:desarrollador|administrador|sin\s+filtros)", 'i', 'HIGH', 'multilingual'),
    Pattern('FR: ignore instructions', r"ignorez\s+(?:toutes\s+)?les\s+(?:instructions|règles|consignes)", 'i', 'HIGH', 'multilingual'),
    Pattern('FR: forget everything', r"oubliez\s+(?:tout|les\s+instructions|tout\s+ce\s+que)", 'i', 'HIGH', 'multilingual'),
    Pattern('FR: act as unrestricted', r"agissez\s+comme\s+(?:un\s+)?(?:assistant\s+)?(?:non\s+restreint|sans\s+filtres|jailbreaké)", 'i', 'HIGH', 'multilingual'),
    Pattern('FR: developer mode', r"mode\s+(?:développeur|administrateur|sans\s+filtre)", 'i', 'HIGH', 'multilingual'),
    Pattern('DE: ignore instructions', r"ignorier(?:e|en)\s+(?:alle\s+)?(?:vorherigen\s+)?(?:anweisungen|regeln|befehle)", 'i', 'HIGH', 'multilingual'),
    Pattern('DE: forget everything', r"vergiss(?:t)?\s+(?:alle|alles|die\s+anweisungen)", 'i', 'HIGH', 'multilingual'),
    Pattern('DE: act as unrestricted', r"verhalte\s+dich\s+wie\s+(?:ein\s+)?(?:uneingeschränkt(?:er|en)?\s+)?(?:assistent|jailbroken)", 'i', 'HIGH', 'multilingual'),
    Pattern('DE: developer mode', r"(?:entwickler|administrator|jailbreak)[-_]?modus", 'i', 'HIGH', 'multilingual'),
    Pattern('IT: ignore instructions', r"ignor[ai]\s+(?:tutte\s+)?(?:le\s+)?(?:istruzioni|regole)", 'i', 'HIGH', 'multilingual'),
    Pattern('IT: forget everything', r"dimentica\s+(?:tutto|le\s+istruzioni)", 'i', 'HIGH', 'multilingual'),
    Pattern('IT: developer mode', r"modalità\s+(?:sviluppatore|amministratore|senza\s+filtri)", 'i', 'HIGH', 'multilingual'),
    Pattern('PT: ignore instructions', r"ignor[ae]\s+(?:todas?\s+)?(?:as\s+)?(?:instruções|regras)", 'i', 'HIGH', 'multilingual'),
    Pattern('PT: forget everything', r"esqueça\s+(?:tudo|as\s+instruções)", 'i', 'HIGH', 'multilingual'),
    Pattern('PT: developer mode', r"modo\s+(?:desenvolvedor|administrador|sem\s+restrições)", 'i', 'HIGH', 'multilingual'),
    Pattern('HI: ignore previous instructions', r"पिछले\s+निर्देश(?:ों)?\s+को\s+(?:नज़र|नजर)\s*अंदाज\s+कर", '', 'HIGH', 'multilingual'),
    Pattern('HI: forget all rules', r"सभी\s+नियम(?:ों)?\s+को\s+(?:भूल|छोड़)", '', 'HIGH', 'multilingual'),
    Pattern('HI/EN: jailbreak', r"जेलब्रेक|jailbreak", 'i', 'HIGH', 'multilingual'),
    Pattern('ZH: ignore previous instructions', r"忽略(?:之前|所有|前面|上面)(?:的)?(?:所有)?(?:的)?(?:指令|指示|提示)", '', 'HIGH', 'multilingual'),
    Pattern('ZH: forget all rules', r"忘记(?:所有|之前)(?:的)?(?:规则|指令)", '', 'HIGH', 'multilingual'),
    Pattern('ZH: developer/admin/jailbreak mode', r"(?:开发者|管理员|越狱)模式", '', 'HIGH', 'multilingual'),
    Pattern('ZH: play unrestricted role', r"扮演(?:一个)?(?:没有限制|无限制|越狱)", '', 'HIGH', 'multilingual'),
    Pattern('JA: ignore previous instructions', r"(?:以前|過去|全て)の指示を(?:無視|忘れて)", '', 'HIGH', 'multilingual'),
    Pattern('JA: developer mode', r"(?:開発者|管理者|脱獄)モード", '', 'HIGH', 'multilingual'),
    Pattern('KO: ignore previous instructions', r"(?:이전|모든)\s*(?:지시|명령)(?:을|를)\s*(?:무시|잊)", '', 'HIGH', 'multilingual'),
    Pattern('KO: developer mode', r"(?:개발자|관리자|탈옥)\s*모드", '', 'HIGH', 'multilingual'),
    Pattern('RU: ignore instructions', r"игнорируй(?:те)?\s+(?:все\s+)?(?:предыдущие\s+)?(?:инструкции|правила)", 'i', 'HIGH', 'multilingual'),
    Pattern('RU: forget everything', r"забудь(?:те)?\s+(?:всё|все\s+инструкции)", 'i', 'HIGH', 'multilingual'),
    Pattern('RU: developer mode', r"режим\s+(?:разработчика|администратора|без\s+ограничений)", 'i', 'HIGH', 'multilingual'),
    Pattern('AR: ignore instructions', r"تجاهل\s+(?:جميع\s+)?(?:التعليمات|الأوامر|القواعد)", '', 'HIGH', 'multilingual'),
    Pattern('AR: forget everything', r"انس(?:ى)?\s+(?:كل\s+)?(?:التعليمات|كل\s+شيء)", '', 'HIGH', 'multilingual'),
    Pattern('TR: ignore/forget instructions', r"(?:tüm\s+)?(?:önceki\s+)?(?:talimatları|kuralları)\s+(?:görmezden\s+gel|unut)", 'i', 'HIGH', 'multilingual'),
    Pattern('VI: ignore instructions', r"(?:bỏ\s+qua|quên)\s+(?:tất\s+cả\s+)?(?:các\s+)?(?:chỉ\s+dẫn|hướng\s+dẫn|quy\s+tắc)", 'i', 'HIGH', 'multilingual'),
    Pattern('DAN mode reference', r"\bDAN\b.{0,40}(?:mode|prompt|version)", 'i', 'HIGH', 'jailbreak'),
    Pattern('STAN mode reference', r"\bSTAN\b.{0,40}(?:mode|prompt)", 'i', 'HIGH', 'jailbreak'),
    Pattern('AIM jailbreak prompt', r"\bAIM\s+prompt\b", 'i', 'HIGH', 'jailbreak'),
    Pattern('grandma jailbreak pattern', r"\bgrandm(?:a|other)\s+(?:used\s+to|would)\s+(?:tell|read|say)", 'i', 'HIGH', 'jailbreak'),
    Pattern('hypothetical-framing harmful request', r"\b(?:hypothetically|in\s+a\s+fictional)\s+(?:speaking|world|scenario)\s*,?\s+how\s+(?:would|could)\s+(?:one|i|someone)\s+(?:make|build|synthesize|create)\s+(?:a\s+)?(?:weapon|bomb|malware|virus|poison)", 'i', 'HIGH', 'jailbreak'),
]
# Offensive requests, with their category (group) and weight.
OFFENSIVE = [
    (Pattern('Malware creation request', r"\b(write|create|generate|produce|build)\s+(?:me\s+)?(?:a\s+)?(?:functional|working)?\s*(malware|virus|worm|trojan|ransomware|keylogger)\b", 'i', "HIGH", 'MALWARE_CREATION'), 1.0),
    (Pattern('AV evasion', r"\bbypass\s+(?:windows|mac|linux|the)?\s*defender\b", 'i', "HIGH", 'EVASION'), 0.9),
    (Pattern('Detection evasion', r"\bavoid\s+(?:av|antivirus|edr|detection)\b", 'i', "HIGH", 'EVASION'), 0.9),
    (Pattern('Exploit dev request', r"\b(?:write|build|develop|create)\s+(?:an?\s+)?exploit\s+(?:for|targeting)\b", 'i', "HIGH", 'EXPLOIT_DEVELOPMENT'), 1.0),
    (Pattern('Credential theft', r"\b(?:steal|harvest|exfiltrate|dump)\s+(?:credentials|passwords|cookies|tokens|sessions)\b", 'i', "HIGH", 'CREDENTIAL_THEFT'), 1.0),
    (Pattern('Phishing artifact', r"\b(?:phish|phishing)\s+(?:email|page|kit|template|landing)\b", 'i', "HIGH", 'PHISHING'), 0.95),
    (Pattern('Unauthorized scanning', r"\b(?:scan|nmap|recon|enumerate)\s+(?:without\s+permission|illegally|unauthorized)\b", 'i', "HIGH", 'UNAUTHORIZED_SCANNING'), 0.9),
    (Pattern('DoS attack', r"\bDDoS\s+(?:attack|tool|script)\b|\bdenial\s+of\s+service\s+attack\b", 'i', "HIGH", 'DDOS'), 1.0),
    (Pattern('Unauthorized remote access', r"\b(?:reverse\s+)?shell\s+(?:on|to)\s+(?:victim|target|their|the\s+target)\b", 'i', "HIGH", 'REMOTE_ACCESS'), 0.95),
    (Pattern('Botnet creation', r"\b(?:write|create|generate)\s+(?:a\s+)?botnet\b", 'i', "HIGH", 'BOTNET'), 1.0),
]
DEFENSIVE = [
    Pattern("defence words", r"\b(?:audit|review|harden|defen[sd]e?|protect|secure|patch|mitigate|remediat\w+|incident\s+response|forensic|blue\s+team|defender|soc\b|threat\s+model|pentest|penetration\s+test)", "i"),
    Pattern("exercise", r"\b(?:ctf|capture\s+the\s+flag|hackthebox|tryhackme|lab\s+environment)", "i"),
    Pattern("permission", r"\bauthorized\b|\bwith\s+permission\b|\bin\s+my\s+lab\b|\bon\s+my\s+own\s+system\b", "i"),
]
# Places in markup that hide text.
STRUCTURAL = [
    Pattern("comment", r"<!--([\s\S]*?)-->"),
    Pattern("attribute", r'\b(?:title|alt|aria-label|data-[a-z\-]+)\s*=\s*"([^"]+)"', "i"),
    Pattern("hidden input", r"""<input[^>]+type=["']hidden["'][^>]+value=["']([^"']+)["']""", "i"),
    Pattern("script", r"<script\b[^>]*>([\s\S]*?)</script>", "i"),
    Pattern("json role", r"""["']role["']\s*:\s*["']system["'][\s\S]{0,200}["']content["']\s*:\s*["']([^"']+)["']""", "i"),
]
# Look-alike letters and what they stand for.
CONFUSABLE_FROM = "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u03bf\u039f\u0391\u0392\u0395\u0397\u0399\u039a\u039c\u039d\u03a1\u03a4\u03a5\u0396"
CONFUSABLE_TO = "aeopcyxABEKMHOPCTXoOABEHIKMNPTYZ"
INVISIBLE = "[\u200b-\u200d\ufeff\u2060\u00ad\u202a-\u202e\u2066-\u2069]"
