"""Expressions of the web3 rules, by name.

Fixed values: they equal those of the audited rule set, in its order; dialect as
in :mod:`scanloom.functions.base_patterns`.
"""

# Fixed values.
WEB3 = {
    'RPC_TOOL_RE': (r"\b(?:eth_(?:sendTransaction|sign|signTypedData(?:_v[34])?|sendRawTransaction|call|getBalance|chainId|accounts|getTransactionByHash|estimateGas|gasPrice|blockNumber|getCode|getLogs|subscribe)|wallet_(?:requestPermissions|switchEthereumChain|addEthereumChain|getPermissions|watchAsset)|personal_sign)\b", ''),
    'VERY_SPECIFIC_PROTOCOL_RE': (r"\b(?:ERC[\s-]?\d{2,5}|EIP[\s-]?\d{2,5}|BIP[\s-]?\d{2,3}|x402|deckard\.network|virtuals(?:\.io)?|Agent\s+Commerce\s+Protocol|Permit2|UniversalRouter|Multicall3|Flashbots|MEV[\s-]?Blocker|gwei|seed\s+phrase|mnemonic\s+phrase|account\s+abstraction|stable\s?coin)\b", 'i'),
    'WEAK_PROTOCOL_RE': (r"\b(?:Uniswap|Aave|Lido|MakerDAO|Curve\s+Finance|Compound\s+Finance|Solidity|EVM(?:\s+chain)?|chainId|on[\s-]?chain|smart\s+contract|private\s+key|EOA|smart\s+account|gas\s+(?:limit|price)|tx\s+hash|transaction\s+hash|wallet\s+address|cryptocurrency)\b", 'i'),
    'ONCHAIN_LANG_RE': (r"\b(?:onchain|on-chain|blockchain|defi|nft|airdrop|chain\s*id|evm|layer-?2|rollup|bridge|wallet|signer|swap)\b", 'i'),
    'SOLIDITY_FILE_RE': (r"\.sol$", 'i'),
    'META_TOOL_DESCRIPTION_RE': (r"\b(?:audit(?:ing|or|s)?|owasp|vulnerabilit(?:y|ies)|security\s+(?:scan|audit|review|tool|scanner|review)|skill\s+(?:audit|scan|review|scanner)|cve\b|sarif|policy\s+(?:engine|preset)|static\s+anal(?:ysis|yzer))\b", 'i'),
    'MARKDOWN_RE': (r"\.(md|mdx)$", 'i'),
    'ADDRESS_RE': (r"\b0x[a-fA-F0-9]{40}\b", ''),
    'HEX_32_RE': (r"\b(?:0x)?[a-fA-F0-9]{64}\b", ''),
    'MNEMONIC_RE': (r"\b(?:[a-z]+\s){11,23}[a-z]+\b", ''),
    'WEB3_LIB_IMPORT_RE': (r"""(?:from\s+["']|require\s*\(\s*["'])(?:ethers|viem|web3|@wagmi\/core|@coinbase\/onchainkit|wagmi|@solana\/web3\.js|@privy-io|@biconomy|@zerodev)""", ''),
    'RPC_URL_RE': (r"""https?:\/\/(?:[a-z0-9-]+\.)*(?:infura\.io|alchemy\.com|quicknode\.com|ankr\.com|rpc\.tenderly\.co|drpc\.org|publicnode\.com|llamarpc\.com|polygon-rpc\.com|optimism\.io|arbitrum\.io|base\.org|bsc-dataseed\.bnbchain\.org)[^\s"'`]*""", 'i'),
    'SEND_TX_RE': (r"\beth_sendTransaction\b|\.sendTransaction\s*\(", ''),
    'SIGN_TX_RE': (r"\bsignTransaction\b|\.signTransaction\s*\(", ''),
    'PERSONAL_SIGN_RE': (r"\beth_sign\b|\bpersonal_sign\b|\.personalSign\s*\(", ''),
    'SIGN_TYPED_DATA_RE': (r"\beth_signTypedData(?:_v[34])?\b|\.signTypedData\s*\(", ''),
    'SEND_RAW_TX_RE': (r"\beth_sendRawTransaction\b|\.sendRawTransaction\s*\(", ''),
    'REQUEST_PERMISSIONS_RE': (r"\b(?:wallet_requestPermissions|requestPermissions)\b", ''),
    'BRIDGE_LIB_RE': (r"\b(?:LayerZero|wormhole|hyperlane|axelar|stargate|across|debridge|connext|synapse|nomad|cBridge)\b|\bccipReceive\b|\bsend\s*\(\s*[^)]*dst(?:ChainId|Eid)\b", 'i'),
    'APPROVE_RE': (r"\.(?:approve|increaseAllowance)\s*\(", ''),
    'MAX_UINT_RE': (r"(?:type\s*\(\s*uint256\s*\)\s*\.\s*max|2\s*\*\*\s*256\s*-\s*1|(?:0x)?[fF]{64})", ''),
    'AUDIT_TOKEN_RE': (r"\b(?:audit|journal|auditTrail)\s*\.\s*[a-zA-Z]\w*\s*\(|\bemit\s+\w+\s*\(|\b(?:AuditSink|AuditTrail|attest|attestation)\b|\bjournal\s*\.\s*record\s*\(", 'i'),
    'POLICY_VERSION_TOKEN_RE': (r"\b(?:policyVersion|policy_version|auditId|requestId|correlationId)\b", ''),
    'AUTONOMY_TOKEN_RE': (r"\b(?:autonomous|automated|agent\s+will)\b", 'i'),
    'SIGNING_FN_RE': (r"\b(?:function|const|let|var|async\s+function)\s+(?:sign(?:Tx|Transaction|Message)?|sendTx|signAndSend)\b|\b(?:async\s+)?(?:sign(?:Tx|Transaction|Message)?|sendTx|signAndSend)\s*[:=]\s*(?:async\s*)?(?:\(|function)", ''),
    'MODEL_VAR_DST_RE': (r"""\bdstChainId\s*[:=]\s*[`'"]?\s*\$\{|\bdstChainId\s*[:=]\s*(?:input|user|response|message|completion|args|params)\b|\bdstEid\s*[:=]\s*[`'"]?\s*\$\{|\bdstEid\s*[:=]\s*(?:input|user|response|message|completion|args|params)\b""", ''),
    'RETRY_RE': (r"\b(?:retry|attempt)\b|catch\s*\([^)]*\)\s*\{[^}]*await", ''),
    'TRACKING_RE': (r"\b(?:messageId|nonce|txHash|messageHash|guid|deliveryHash)\b", ''),
    'VERIFYING_CONTRACT_RE': (r"""verifyingContract\s*[:=]\s*["']?(0x[a-fA-F0-9]{40})["']?""", ''),
    'PARTIAL_FINALITY_RE': (r"\b(?:setTimeout|setInterval)\s*\(|\b(?:sleep|wait)\s*\(\s*\d+", ''),
    'FOLLOW_UP_TX_RE': (r"\.(?:sendTransaction|signTransaction|writeContract|sendUserOperation)\s*\(|eth_sendTransaction|eth_sendRawTransaction", ''),
    'BRIDGE_PROSE_RE': (r"\b(?:bridge|cross[-\s]?chain|l2\s*(?:->|→|to)\s*l1|l1\s*(?:->|→|to)\s*l2)\b", 'i'),
    'FAST_NAME_RE': (r"-fast$", 'i'),
    'FLAG_BYPASS_RE': (r"(?:--auto-approve|--no-confirm|--yes\b|(?<![\w-])-y\b)", 'i'),
    'PHRASE_BYPASS_RE': (r"\bskip(?:s|ping)?\s+(?:(?:user|the)\s+)?confirmation\b|\bwithout\s+confirming\b|\b(?:do\s+not|don'?t|no)\s+prompt\b|\bbroadcast(?:s|ing)?\s+(?:immediately|without\s+confirmation)\b|\bbypass(?:es)?\s+user\b", 'i'),
    'DANGER_WARNING_RE': (r"\bEXTREMELY\s+DANGEROUS\b|\buse\s+only\s+after\s+audit\b|\bin\s+CI\s+only\b", 'i'),
    'TO_FROM_MODEL_RE': (r"to\s*:\s*\$\{[^}]*\b(?:input|user|response|message|completion|reply|args)\b|to\s*=\s*(?:input|user|response|message|completion|reply|args)\b", ''),
    'LOWERCASE_COMPARE_RE': (r"\.toLowerCase\(\)\s*===|\.toLowerCase\(\)\s*==", ''),
    'RESOLVE_NAME_RE': (r"\.resolveName\s*\(|\bensRegistry\b|\bnamehash\s*\(", ''),
    'REVERSE_RESOLVE_RE': (r"\blookupAddress\s*\(|\breverseResolve\b", ''),
    'ADDRESS_LITERAL_LINE_RE': (r"0x[a-fA-F0-9]{40}", ''),
    'ADDRESS_POISONING_MD_RE': (r"\b(?:transaction history|recent transactions|previous transfer)\b", 'i'),
    'TX_HISTORY_CODE_RE': (r"\btx\.history\b|\bgetTransactions\s*\(|\beth_getTransactionByHash\b", ''),
    'ALLOWLIST_HINT_RE': (r"\b(?:allow[Ll]ist|allowed[A-Z]\w*|whitelist|isAllowed|inAllowlist)\b", ''),
    'SET_CODE_AUTH_RE': (r"""SetCodeAuthorization|setCodeAuthorization|signAuthorization|eth_signAuthorization|tx\.type\s*=\s*['"]?0x04|type\s*:\s*['"]?(?:0x)?04['"]?|authorizationList\s*[:=]""", ''),
    'CHAIN_ID_ZERO_RE': (r"chainId\s*:\s*0[\s,}]|chain_id\s*=\s*0[\s,]", ''),
    'REVOKE_OR_EXPIRY_RE': (r"\b(?:revokeAfter|expiry|expiresAt|expireAt|deadline)\b", ''),
    'PROSE_HINT_RE': (r"\b(?:wallet upgrade|gas sponsorship|smart account install)\b", 'i'),
    'STRINGIFY_RE': (r"JSON\s*\.\s*stringify\s*\(", ''),
    'SIGN_RE': (r"\bsigner\s*\.\s*signTransaction\s*\(", ''),
    'CHAIN_TOOL_RE': (r"\beth_(?:sendTransaction|sign|signTypedData|sendRawTransaction|call|getBalance|chainId)\b|\bwallet_(?:requestPermissions|switchEthereumChain|addEthereumChain)\b|\bchain_\w+", ''),
    'STDIO_TRANSPORT_RE': (r"^(?:node|python|deno|bun|npx|uvx)\b", 'i'),
    'MCP_PROSE_RE': (r"\b(?:Model\s+Context\s+Protocol|MCP\s+(?:server|tool))\b", 'i'),
    'CHAIN_PROSE_RE': (r"(?:\beth(?:_\w+)?\b|\bwallet(?:_\w+)?\b|\bchain(?:_\w+)?\b|\b(?:rpc|onchain|on-chain|evm|web3|blockchain|swap|signer|wagmi|viem|ethers)\b)", 'i'),
    'QUOTE_RE': (r"\b(?:getReserves|slot0|getAmountsOut|quoteExactInputSingle)\s*\(", ''),
    'SWAP_SPECIFIC_RE': (r"\b(?:swapExactTokens(?:For(?:Tokens|ETH)(?:SupportingFeeOnTransferTokens)?)?|swapExactETH(?:ForTokens(?:SupportingFeeOnTransferTokens)?)?|exactInput(?:Single)?|exactOutput(?:Single)?)\s*\(", ''),
    'SWAP_GENERIC_RE': (r"\bswap\s*\(", ''),
    'SWAP_KEYWORDS_RE': (r"\b(?:swapExactTokens|swapExactETH|exactInput|exactOutput|swap\s*\()", ''),
    'MIN_OUT_RE': (r"\b(?:minAmountOut|amountOutMin|minOut|amountOutMinimum)\b", ''),
    'SLIPPAGE_LITERAL_RE': (r"""slippage\s*[:=]\s*(?:['"](\d+(?:\.\d+)?)['"]|(\d+(?:\.\d+)?))(?!\s*[a-zA-Z_])""", ''),
    'SLIPPAGE_VARIABLE_RE': (r"slippage\s*[:=]\s*((?:[A-Za-z_$][\w$]*\.)+[A-Za-z_$][\w$]*)", ''),
    'DEADLINE_RE': (r"deadline\s*[:=]\s*[^,)]*\+\s*(\d+)", ''),
    'SETINTERVAL_RE': (r"\bsetInterval\s*\(", ''),
    'PERMIT_KEYWORD_RE': (r"\b(?:PermitSingle|PermitBatch|permit2)\b", 'i'),
    'UNBOUNDED_AMOUNT_RE': (r"""\bamount\s*:\s*(?:["'`]?(?:2\s*\*\*\s*256\s*-\s*1|0x[fF]{64}|MAX_UINT256|type\s*\(\s*uint256\s*\)\s*\.\s*max)["'`]?|BigInt\s*\(\s*["']?0x[fF]{64}["']?\s*\)|ethers\.MaxUint256|maxUint256)""", ''),
    'PERMIT_PRIMARY_TYPE_RE': (r"""primaryType\s*:\s*['"]Permit(?:Single|Batch)?['"]""", ''),
    'SPENDER_TEMPLATE_RE': (r"""spender\s*:\s*[`"']?\s*\$\{([^}]+)\}""", ''),
    'SPENDER_VAR_RE': (r"spender\s*:\s*([a-zA-Z_]\w*)(?:\s*[,}])", ''),
    'SOLIDITY_PERMIT_DEADLINE_RE': (r"permit\s*\([^)]*deadline\s*[,:]\s*(?:type\s*\(\s*uint256\s*\)\s*\.\s*max|2\s*\*\*\s*256|0xff{8,})", 'i'),
    'PERMIT_MENTION_RE': (r"\b(?:permit|gasless\s+approval)\b", 'i'),
    'MANIFEST_FILE_RE': (r"(?:^|\/)(?:SKILL\.md|skill\.md|manifest\.json|claw\.json)$", 'i'),
    'FEE_TOKENS_RE': (r"\b(?:fee|feeBps|feeRecipient|swapFeeRecipient|swapFeeBps|affiliate|referrer|partner|takerFee|protocolFee|skimRecipient|treasury)\b", 'i'),
    'ADDRESS_LITERAL_RE': (r"\b0x[a-fA-F0-9]{40}\b", ''),
    'ZERO_FEE_DISCLAIMER_RE': (r"""\b(?:fee|feeBps|swapFeeBps|takerFee|protocolFee)\w*\s*[:=]\s*['"]?0['"]?(?![\w.])""", 'i'),
    'ENV_RPC_RE': (r"process\.env\.(?:[A-Z0-9_]*RPC[A-Z0-9_]*|RPC_URL)\b", ''),
    'CHAIN_ID_CHECK_RE': (r"\beth_chainId\b|\bgetChainId\s*\(|\bgetNetwork\s*\(", ''),
    'PROTECTED_RPC_REFERENCE_RE': (r"\b(?:flashbots|mevblocker|blxrbdn|edennetwork|eth-protect|rpc\.flashbots\.net|rpc\.mevblocker\.io)\b", 'i'),
    'EMBEDDED_KEY_RE': (r"\/[a-zA-Z0-9_-]{20,}(?:[/?#]|$)", ''),
    'NEARBY_EXPIRY_RE': (r"\b(?:expiry|expiration)\b", ''),
    'NULLISH_EXPIRY_RE': (r"\bexpiry\s*:\s*(?:undefined|null)\b", ''),
    'TYPED_DATA_FROM_JSON_STRINGIFY_RE': (r"signTypedData[^(]*\(\s*[^,)]*JSON\.stringify\b|signTypedData[^(]*\([^)]*?\$\{\s*(?:input|user|response|message|completion|prompt)", ''),
    'SIGN_TYPED_DATA_CALL_RE': (r"\bsignTypedData\b", ''),
    'DOMAIN_OPEN_RE': (r"domain\s*:\s*\{|EIP712Domain", ''),
    'TYPED_DATA_HELPER_IMPORT_RE': (r"""(?:from\s+["']|require\s*\(\s*["'])(?:viem(?:\/[^"']*)?|ethers(?:\/utils)?|@metamask\/eth-sig-util)["']""", ''),
    'SIGN_PROMPT_LANGUAGE_RE': (r"\b(?:sign\s+this\s+message|approve\s+this\s+transaction|please\s+sign|sign\s+the\s+(?:message|transaction)|approve\s+the\s+(?:transaction|message))\b", 'i'),
}
