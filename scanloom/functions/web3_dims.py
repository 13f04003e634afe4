"""Addresses, hosts and word lists of the web3 rules."""

# Allowed Permit2 spenders, delegates, bridge endpoints and known contracts.
PERMIT2 = "0x000000000022D473030F116dDEE9F6B43aC78BA3"
MULTICALL3 = "0xcA11bde05977b3631167028862bE2a173976CA11"
PERMIT2_SPENDERS = [
    "0x66a9893cC07D91D95644AEDD05D03f95e1dBA8Af",
    "0x6fF5693b99212Da76ad316178A184AB56D299b43",
    "0xA51afAFe0263b40EdaEf0Df8781eA9aa03E381a3",
    "0x851116D9223fabED8E56C0E6b8Ad0c31d98B3507",
    "0x000000000000175a8b9bC6d539B3708EEd92EA6c",
    "0x111111125421cA6dc452d289314280a0f8842A65",
    "0x0000000000001fF3684f28c67538d4D072C22734",
    "0xC92E8bdf79f0507f65a392b0ab4667716BFE0110",
    "0x6A000F20005980200259B80c5102003040001068",
]
DELEGATES = [
    "0x63c0c19a282a1B52b07dD5a65b58948A07DAE32B",
    "0xc807e230f55d3f44A52b65A5BC1b50A0bF863a76",
    "0x000000004F43C49e93C970E84001853a70923B03",
    "0xd6CEDDe84be40893d153Be9d467CD6aD37875b28",
    "0xba6cb27ad8e6502b2b1cFcEB44C1bbb0AcE3a169",
    "0x8E8e658E22B12ada97B402fF0b044D6A325013C7",
    "0xb0c0a3aE013D6E5DC52F32F4f3019D44A9bA48A1",
]
BRIDGE_ENDPOINTS = [
    "0x1a44076050125825900e736c501f859c50fE728c",
    "0x80226fc0Ee2b096224EeAc085Bb9a8cba1146f7D",
    "0x98f3c9e6E3fAce36bAAd05FE09d375Ef1464288B",
    "0xc005dc82818d67AF737725bD4bf75435d065D239",
    "0x4F4495243837681061C4743b74B3eEdf548D56A5",
    "0x5c7BCd6E7De5423a257D81B442095A1a6ced35C5",
    "0xeCc19E177d24551aA7ed6Bc6FE566eCa726CC8a9",
    "0x6571d6be3d8460CF5F7d6711Cd9961860029D85F",
    "0x8898B472C54c31894e3B9bb83cEA802a5d0e63C6",
]
NULL_SINKS = ["0x" + "0" * 40, "0x" + "0" * 36 + "dead"]
PROTECTED_RPCS = ["https://rpc.flashbots.net/fast", "https://rpc.mevblocker.io", "https://eth-protect.rpc.blxrbdn.com", "https://api.edennetwork.io/v1/rpc"]
MCP_HOSTS = [
    "localhost", "127.0.0.1", "::1", "mcp.anthropic.com", "*.coinbase.com", "*.metamask.io", "*.modelcontextprotocol.io", "smithery.ai",
    "*.smithery.ai", "gitmcp.io", "*.gitmcp.io", "pulse.so", "*.pulse.so", "hyper-mcp.com", "*.hyper-mcp.com",
]

# Words that the rules look for.
TAINTED_NAMES = "input user request params body args response completion".split()
AUTONOMY_VERBS = ["trade", "swap", "buy", "sell", "rebalance", "execute"]
AUTONOMY_QUALIFIERS = ["for you", "automatically", "autonomous"]
TRADE_ACTIONS = ["swap", "trade", "buy", "sell", "liquidate", "rebalance"]
MODEL_NAMES = r"\b(?:response|completion|message|model|answer|llm|output|reply|choices|tool|args)\b"
ENV_KEYS = ["PRIVATE_KEY", "MNEMONIC", "SEED_PHRASE", "WALLET_KEY"]
SIGNER_FIELDS = ["privateKey", "mnemonic", "seed", "signer"]
MNEMONIC_WORDS = (
    "abandon ability able about above absent absorb abstract absurd abuse access accident account accuse achieve acid acoustic acquire across act "
    "action actor actress actual adapt add addict address adjust admit adult advance advice aerobic affair afford afraid again age agent agree "
    "ahead aim air airport aisle alarm album alcohol alert alien"
).split()
STUB_VERSIONS = ["0.0.0", "0.1.0"]
STUB_LICENSES = ["", "UNKNOWN", "unknown", "TBD", "TODO", "NONE", "none"]
PLATFORMS = ["openclaw", "hermes", "claude", "codex"]
MAX_SESSION_SECONDS = 7 * 24 * 3600

# Expressions for logging lines, public values and assignments.
LOG_LINES = [r"\bconsole\s*\.\s*(?:log|info|debug|warn|error|trace)\s*\(", r"\b(?:logger|log)\s*\.\s*[a-zA-Z]+\s*\(", r"`[^`]*\$\{[^}]*\}"]
PUBLIC_VALUE = r"\b(?:pubkey|publicKey|publickey|pub_key|addr|address|hash|txHash|tx_hash|blockHash|block_hash)\b"
KEY_CONSTANT = r"""\b(?:const|let|var)\s+[A-Z_][A-Z0-9_]*(?:KEY|MNEMONIC|SEED|SECRET)[A-Z0-9_]*\s*=\s*["'`]"""
STRING_BEGUN = r"""=\s*["'`][^"'`]*$"""
SIGNER_LOGGED = r"console\s*\.\s*log\s*\([^)]*(?:signer|tx)\b"
CALL_ARGUMENTS = [r"0x[a-fA-F0-9]{6,}", r"[,;]", r"\d{6,}", r"[{}\[\]]", r"[A-Za-z_$][\w$]*\s*:", r"[A-Za-z_$][\w$]*\s*\("]
