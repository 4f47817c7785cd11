"""The 90 enriched patterns.  Fixed values, in their natural order.

A row is: id, name, regex, severity, layer, category, confidence, and then by name the cross-layer hint, the description and the fix hint.
"""

from faultline.rules.patterns import Pattern

# Fixed values.
ENRICHED_PATTERNS: list[Pattern] = [
    Pattern("L001", "LOKi SIGSEGV", r"signal 11 .SIGSEGV", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.97, description="LOKi process received SIGSEGV", fix_hint="Check null pointer dereference in crash frame 0"),
    Pattern("L002", "LOKi null deref address", r"Fault addr:?\s+0x0+\b", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.95, fix_hint="Null pointer dereference – add nullptr guard"),
    Pattern("L003", "LOKi backtrace frame 0", r"#00 pc [0-9a-f]+ .*/loki", "high", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.85, fix_hint="Examine #00 call site for null reference"),
    Pattern("L004", "Android tombstone SIGSEGV", r"signal 11 \(SIGSEGV\).*code 1 \(SEGV_MAPERR\)", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.97, fix_hint="Unmapped address access"),
    Pattern("L005", "LOKi crash abort", r"SIGABRT.*loki", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.9, fix_hint="Check SIGABRT source – likely abort() or assert()"),
    Pattern("L006", "AddressSanitizer heap overflow", r"heap-buffer-overflow", "critical", "LOKI", "LOKI_MEMORY_CORRUPTION", 0.99, fix_hint="Bounds check needed at flagged alloc site"),
    Pattern("L007", "AddressSanitizer use-after-free", r"heap-use-after-free", "critical", "LOKI", "LOKI_MEMORY_CORRUPTION", 0.99, fix_hint="Lifetime issue – use shared_ptr or weak_ptr"),
    Pattern("L008", "AddressSanitizer stack overflow", r"stack-buffer-overflow", "critical", "LOKI", "LOKI_MEMORY_CORRUPTION", 0.99, fix_hint="Stack buffer too small – increase or use heap"),
    Pattern("L009", "AddressSanitizer double-free", r"double-free", "critical", "LOKI", "LOKI_MEMORY_CORRUPTION", 0.99, fix_hint="Track ownership – use RAII or unique_ptr"),
    Pattern("L010", "Memory corruption canary", r"stack canary .* detected", "critical", "LOKI", "LOKI_MEMORY_CORRUPTION", 0.95, fix_hint="Stack smash – check array write bounds"),
    Pattern("L011", "ThreadSanitizer data race", r"DATA RACE", "high", "LOKI", "LOKI_RACE_CONDITION", 0.99, fix_hint="Add mutex/lock around flagged shared access"),
    Pattern("L012", "ThreadSanitizer race location", r"ThreadSanitizer: data race", "high", "LOKI", "LOKI_RACE_CONDITION", 0.99, fix_hint="Synchronise flagged shared variable"),
    Pattern("L013", "LOKi mutex deadlock", r"mutex.*deadlock|deadlock.*mutex", "high", "LOKI", "LOKI_RACE_CONDITION", 0.85, fix_hint="Break deadlock – use lock order or try_lock"),
    Pattern("L014", "LOKi thread timeout", r"thread.*timed? ?out.*loki", "medium", "LOKI", "LOKI_RACE_CONDITION", 0.7, fix_hint="Increase timeout or unblock waiting thread"),
    Pattern("L015", "LOKi AppLauncher failure", r"AppLauncher.*fail|launch.*failed.*LOKi", "high", "LOKI", "LOKI_APP_LAUNCH_FAILURE", 0.9, fix_hint="Check AppLauncher::launch() error path"),
    Pattern("L016", "LOKi app start timeout", r"app.*start.*timeout|timeout.*starting.*app", "high", "LOKI", "LOKI_APP_LAUNCH_FAILURE", 0.85, fix_hint="Increase launch timeout or fix blocking init"),
    Pattern("L017", "AppRegistry missing entry", r"AppRegistry.*not found|no entry.*AppRegistry", "medium", "LOKI", "LOKI_APP_LAUNCH_FAILURE", 0.8, fix_hint="Register app in AppRegistry manifest"),
    Pattern("L018", "LOKi app process died", r"Process.*died.*app|app.*process.*killed", "high", "LOKI", "LOKI_APP_LAUNCH_FAILURE", 0.85, fix_hint="Check app crash logs"),
    Pattern("L019", "IR key routing failure", r"IR.*rout.*fail|key.*dispatch.*fail", "high", "LOKI", "LOKI_IR_ROUTING_FAILURE", 0.9, fix_hint="Verify IR key table mappings"),
    Pattern("L020", "IR receiver timeout", r"IR.*receiver.*timeout|timeout.*IR", "medium", "LOKI", "LOKI_IR_ROUTING_FAILURE", 0.8, fix_hint="Check IR receiver hardware connection"),
    Pattern("L021", "Key event drop", r"key.*event.*drop|drop.*key.*event", "medium", "LOKI", "LOKI_IR_ROUTING_FAILURE", 0.75, fix_hint="Increase key event queue depth"),
    Pattern("L022", "Companion server deadlock", r"companion.*server.*deadlock|deadlock.*companion", "critical", "LOKI", "LOKI_COMPANION_SERVER_DEADLOCK", 0.95, cross_hint=True, fix_hint="Break companion server lock cycle"),
    Pattern("L023", "Companion server timeout", r"companion.*server.*timeout|CompanionServer.*block", "high", "LOKI", "LOKI_COMPANION_SERVER_DEADLOCK", 0.85, cross_hint=True, fix_hint="Add async timeout to companion server calls"),
    Pattern("L024", "VIZIO library did not load", r"VIZIO_LIBRARY_DID_LOAD.*timeout|companion.*library.*timeout", "high", "LOKI", "LOKI_COMPANION_SERVER_DEADLOCK", 0.8, cross_hint=True, fix_hint="Fix companion library load race"),
    Pattern("L025", "EPG parse failure", r"EPG.*parse.*error|parse.*EPG.*fail", "medium", "LOKI", "LOKI_EPG_PARSE_ERROR", 0.9, fix_hint="Validate EPG XML schema"),
    Pattern("L026", "EPG data malformed", r"malformed.*EPG|EPG.*malform", "medium", "LOKI", "LOKI_EPG_PARSE_ERROR", 0.85, fix_hint="Add EPG schema validation"),
    Pattern("L027", "EPG stream read error", r"EPG.*stream.*eof|eof.*EPG", "low", "LOKI", "LOKI_EPG_PARSE_ERROR", 0.7, fix_hint="Retry EPG fetch on EOF"),
    Pattern("L028", "OTA download failure", r"OTA.*download.*fail|fail.*OTA.*download", "high", "LOKI", "LOKI_OTA_UPDATE_FAILURE", 0.9, fix_hint="Implement OTA download retry with backoff"),
    Pattern("L029", "OTA verification failure", r"OTA.*verif.*fail|signature.*OTA.*invalid", "critical", "LOKI", "LOKI_OTA_UPDATE_FAILURE", 0.95, fix_hint="Check OTA signing key and hash"),
    Pattern("L030", "OTA flash failure", r"OTA.*flash.*fail|flash.*fail.*OTA", "critical", "LOKI", "LOKI_OTA_UPDATE_FAILURE", 0.9, fix_hint="Check storage space before OTA flash"),
    Pattern("H001", "VIZIO_LIBRARY_DID_LOAD event missing", r"VIZIO_LIBRARY_DID_LOAD.*not.*fired|waiting.*VIZIO_LIBRARY_DID_LOAD", "high", "HTML5", "COMPANION_LIB_TIMING", 0.95, cross_hint=True, fix_hint="Fire VIZIO_LIBRARY_DID_LOAD after companion init"),
    Pattern("H002", "Companion lib load timeout", r"window\.VIZIO.*undefined|VIZIO.*not defined", "high", "HTML5", "COMPANION_LIB_TIMING", 0.9, fix_hint="Check companion lib injection timing"),
    Pattern("H003", "Companion lib API race", r"companion.*API.*race|race.*companion.*API", "high", "HTML5", "COMPANION_LIB_TIMING", 0.85, cross_hint=True, fix_hint="Await VIZIO_LIBRARY_DID_LOAD before API calls"),
    Pattern("H004", "Companion server not ready", r"CompanionServer.*not ready|companion.*server.*unavail", "medium", "HTML5", "COMPANION_LIB_TIMING", 0.8, cross_hint=True, fix_hint="Retry companion server connection"),
    Pattern("H005", "JavaScript heap OOM", r"javascript heap out of memory|JS Heap.*OOM", "critical", "HTML5", "JS_HEAP_OOM", 0.99, fix_hint="Identify memory leak; use WeakRef or finalizers"),
    Pattern("H006", "Chromium OOM killer", r"OOM.*Chromium|chromium.*killed.*OOM|renderer.*OOM", "critical", "HTML5", "JS_HEAP_OOM", 0.95, fix_hint="Reduce renderer memory pressure"),
    Pattern("H007", "Memory pressure listener", r"onmemorypressure|memoryPressure.*critical", "high", "HTML5", "JS_HEAP_OOM", 0.85, fix_hint="Release caches on memory pressure event"),
    Pattern("H008", "EME key session error", r"createMediaKeys.*fail|MediaKeySession.*error", "high", "HTML5", "EME_DRM_FAILURE", 0.9, fix_hint="Retry EME key session creation"),
    Pattern("H009", "DRM license failure", r"license.*request.*fail|DRM.*license.*error", "high", "HTML5", "EME_DRM_FAILURE", 0.9, fix_hint="Check license server URL and auth token"),
    Pattern("H010", "Widevine decrypt error", r"widevine.*decrypt.*error|DECRYPT.*WIDEVINE", "critical", "HTML5", "EME_DRM_FAILURE", 0.95, fix_hint="Verify Widevine CDM version compatibility"),
    Pattern("H011", "Keydown event not fired", r"keydown.*not.*fired|missing.*keydown.*event", "high", "HTML5", "KEYDOWN_NOT_FIRED", 0.9, fix_hint="Check key event routing in focus manager"),
    Pattern("H012", "Focus management failure", r"focus.*trap|lost.*focus|focus.*not.*set", "medium", "HTML5", "KEYDOWN_NOT_FIRED", 0.75, fix_hint="Restore focus to interactive element"),
    Pattern("H013", "Key event preventDefault", r"preventDefault.*key|key.*event.*cancelled", "medium", "HTML5", "KEYDOWN_NOT_FIRED", 0.7, fix_hint="Check for erroneous preventDefault() calls"),
    Pattern("H014", "Fetch network timeout", r"fetch.*timeout|network.*timeout.*fetch", "high", "HTML5", "FETCH_NETWORK_TIMEOUT", 0.9, fix_hint="Add AbortController with timeout to fetch()"),
    Pattern("H015", "XMLHttpRequest timeout", r"xhr.*timeout|XMLHttpRequest.*timeout", "medium", "HTML5", "FETCH_NETWORK_TIMEOUT", 0.85, fix_hint="Set xhr.timeout and handle ontimeout"),
    Pattern("H016", "Network offline", r"navigator\.onLine.*false|offline.*network", "medium", "HTML5", "FETCH_NETWORK_TIMEOUT", 0.75, fix_hint="Handle navigator.onLine=false gracefully"),
    Pattern("H017", "Shaka 3016 MSE seek", r"Shaka.*3016|MEDIA_SOURCE_MUTUALLY_EXCLUSIVE", "high", "HTML5", "SHAKA_ERROR_3016", 0.99, fix_hint="Prevent concurrent MSE segment appends"),
    Pattern("H018", "Shaka MSE error", r"shaka.*media.source.*error|MSE.*shaka", "high", "HTML5", "SHAKA_ERROR_3016", 0.9, fix_hint="Reset MediaSource on Shaka MSE error"),
    Pattern("H019", "Shaka DASH manifest error", r"shaka.*DASH.*manifest.*error|manifest.*shaka.*fail", "medium", "HTML5", "SHAKA_ERROR_3016", 0.85, fix_hint="Validate DASH manifest URL and headers"),
    Pattern("H020", "Netflix MSL timeout", r"MSL.*timeout|netflix.*msl.*timeout", "high", "HTML5", "NETFLIX_MSL_TIMEOUT", 0.95, fix_hint="Retry Netflix MSL handshake"),
    Pattern("H021", "Netflix nfp error", r"nfp\.error|netflix.*playback.*error", "high", "HTML5", "NETFLIX_MSL_TIMEOUT", 0.9, fix_hint="Check Netflix app version for Chromium compat"),
    Pattern("H022", "Netflix auth failure", r"netflix.*auth.*fail|netflix.*401", "high", "HTML5", "NETFLIX_MSL_TIMEOUT", 0.85, fix_hint="Refresh Netflix device certificates"),
    Pattern("H023", "Amazon DASH manifest error", r"amazon.*DASH.*manifest|dash\.js.*amazon.*error", "high", "HTML5", "AMAZON_DASH_MANIFEST", 0.9, fix_hint="Update Amazon DASH manifest parsing"),
    Pattern("H024", "Amazon video decode failure", r"amazon.*video.*decode.*fail|decode.*error.*amazon", "high", "HTML5", "AMAZON_DASH_MANIFEST", 0.85, fix_hint="Check codec support for Amazon streams"),
    Pattern("H025", "Hulu ad MSE break", r"hulu.*ad.*MSE.*break|MSE.*break.*hulu", "high", "HTML5", "HULU_AD_MSE_BREAK", 0.95, fix_hint="Handle MSE SourceBuffer abort() on ad break"),
    Pattern("H026", "Hulu VideoJS error", r"videojs.*hulu.*error|hulu.*videojs.*error", "medium", "HTML5", "HULU_AD_MSE_BREAK", 0.85, fix_hint="Update VideoJS ad plugin"),
    Pattern("H027", "WatchFree deeplink loss", r"WatchFree.*deeplink.*loss|deeplink.*WatchFree.*fail", "high", "HTML5", "WATCHFREE_DEEPLINK_LOSS", 0.9, cross_hint=True, fix_hint="Fix LOKi deeplink IPC before React hydration"),
    Pattern("H028", "WatchFree deeplink IPC failure", r"deeplink.*IPC|IPC.*deeplink.*watchfree", "high", "HTML5", "WATCHFREE_DEEPLINK_LOSS", 0.85, cross_hint=True, fix_hint="Serialise deeplink before React app mount"),
    Pattern("H029", "Chromium version mismatch", r"chromium.*version.*incompatible|chromium.*compat.*error", "medium", "HTML5", "CHROMIUM_VERSION_COMPAT", 0.85, fix_hint="Check Chromium minimum version for API usage"),
    Pattern("H030", "Deprecated Web API", r"deprecated.*API|API.*deprecated.*chromium", "low", "HTML5", "CHROMIUM_VERSION_COMPAT", 0.7, fix_hint="Replace deprecated Web API"),
    Pattern("H031", "Focus lost on navigation", r"focus.*lost.*navigat|navigation.*focus.*lost", "medium", "HTML5", "FOCUS_MANAGEMENT", 0.85, fix_hint="Preserve focus on route change"),
    Pattern("H032", "SpatialNavigation failure", r"SpatialNavigation.*fail|spatial.*nav.*error", "medium", "HTML5", "FOCUS_MANAGEMENT", 0.8, fix_hint="Enable SpatialNavigation fallback"),
    Pattern("H033", "Event listener leak", r"addEventListener.*leak|event.*listener.*not.*removed", "medium", "HTML5", "MEMORY_LEAK_EVENT_LISTENER", 0.85, fix_hint="Remove event listeners in component cleanup"),
    Pattern("H034", "DOM node leak", r"DOM.*node.*leak|leak.*DOM.*node", "medium", "HTML5", "MEMORY_LEAK_EVENT_LISTENER", 0.8, fix_hint="Detach DOM nodes before dropping references"),
    Pattern("H035", "React component leak", r"React.*component.*leak|unmount.*leak", "medium", "HTML5", "MEMORY_LEAK_EVENT_LISTENER", 0.75, fix_hint="Check componentWillUnmount for cleanup"),
    Pattern("M001", "MTK VDEC crash", r"VDEC.*crash|vdec.*kernel.*oops|mtk.*video.*decoder.*fail", "critical", "MEDIATEK", "MTK_VDEC_CRASH", 0.97, fix_hint="Auto-escalate to MediaTek – no fix generated"),
    Pattern("M002", "VDEC kernel oops", r"Oops.*VDEC|kernel.*oops.*vdec", "critical", "MEDIATEK", "MTK_VDEC_CRASH", 0.95, fix_hint="File MediaTek VDEC bug report"),
    Pattern("M003", "Video decoder hang", r"video.*decoder.*hang|VDEC.*hang", "critical", "MEDIATEK", "MTK_VDEC_CRASH", 0.9, fix_hint="Trigger VDEC recovery or reboot"),
    Pattern("M004", "Mali GPU hang", r"Mali.*GPU.*hang|GPU.*hung.*Mali|mali.*TDR", "critical", "MEDIATEK", "MTK_MALI_GPU_HANG", 0.97, fix_hint="Auto-escalate – Mali driver hang"),
    Pattern("M005", "Mali register dump", r"Mali.*register dump|GPU.*register.*dump", "high", "MEDIATEK", "MTK_MALI_GPU_HANG", 0.9, fix_hint="Capture Mali register dump for debugging"),
    Pattern("M006", "Mali job fault", r"Mali.*job.*fault|JM.*fault.*mali", "high", "MEDIATEK", "MTK_MALI_GPU_HANG", 0.88, fix_hint="Check Mali shader compiler output"),
    Pattern("M007", "HDCP authentication failure", r"HDCP.*auth.*fail|HDCP.*2\.2.*error|HDCP.*handshake.*fail", "critical", "MEDIATEK", "MTK_HDCP_FAILURE", 0.95, fix_hint="Verify HDCP keys and HDMI sink support"),
    Pattern("M008", "HDCP re-auth loop", r"HDCP.*re-?auth.*loop|repeated.*HDCP.*fail", "high", "MEDIATEK", "MTK_HDCP_FAILURE", 0.85, fix_hint="Check HDMI cable / HDCP repeater"),
    Pattern("M009", "TEE Widevine error", r"TEE.*Widevine.*error|Widevine.*TEE.*fail", "critical", "MEDIATEK", "MTK_TEE_WIDEVINE", 0.97, fix_hint="Auto-escalate – TEE firmware issue"),
    Pattern("M010", "Widevine L1 CDM error", r"Widevine.*L1.*error|WVCdm.*error", "critical", "MEDIATEK", "MTK_TEE_WIDEVINE", 0.95, fix_hint="Reprovision Widevine L1 device"),
    Pattern("M011", "ADSP crash", r"ADSP.*crash|audio.*DSP.*crash|mtk.*adsp.*fault", "critical", "MEDIATEK", "MTK_ADSP_CRASH", 0.97, fix_hint="Auto-escalate – ADSP firmware crash"),
    Pattern("M012", "ADSP timeout", r"ADSP.*timeout|audio.*dsp.*timeout", "high", "MEDIATEK", "MTK_ADSP_CRASH", 0.85, fix_hint="Check ADSP IPC timeout"),
    Pattern("M013", "MMC I/O error", r"mmcblk.*I/O error|blk_update_request.*I/O error.*mmcblk", "critical", "MEDIATEK", "MTK_MMC_IO_ERROR", 0.97, fix_hint="eMMC storage failure – escalate hardware"),
    Pattern("M014", "eMMC read failure", r"mmc.*read.*fail|failed.*read.*mmc", "high", "MEDIATEK", "MTK_MMC_IO_ERROR", 0.9, fix_hint="Check eMMC health and retry logic"),
    Pattern("M015", "Flash write timeout", r"flash.*write.*timeout|NAND.*write.*timeout", "critical", "MEDIATEK", "MTK_MMC_IO_ERROR", 0.88, fix_hint="Verify flash wear levelling and block health"),
    Pattern("X001", "LOKi process crash line", r"/3rd/loki/bin/loki.*crash|crashed.*loki", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.88, fix_hint="Inspect LOKi crash tombstone"),
    Pattern("X002", "Android tombstone begin", r"-----\s*beginning of crash\s*-----", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.7, fix_hint="Read full tombstone for crash details"),
    Pattern("X003", "Kernel NULL ptr deref", r"Unable to handle kernel NULL pointer dereference", "critical", "MEDIATEK", "MTK_VDEC_CRASH", 0.9, fix_hint="Kernel NULL deref – escalate to driver team"),
    Pattern("X004", "LOKi watchdog timeout", r"watchdog.*timeout.*loki|loki.*watchdog.*expired", "high", "LOKI", "LOKI_APP_LAUNCH_FAILURE", 0.8, fix_hint="Increase watchdog timeout or fix blocking call"),
    Pattern("X005", "LOKi IPC timeout", r"IPC.*timeout.*loki|loki.*IPC.*timeout", "high", "LOKI", "LOKI_IR_ROUTING_FAILURE", 0.8, cross_hint=True, fix_hint="Check binder / IPC queue depth"),
    Pattern("X006", "Chromium renderer crash", r"Renderer.*crash|[Cc]ontent.*[Rr]ender.*crash", "high", "HTML5", "JS_HEAP_OOM", 0.75, fix_hint="Check Chromium renderer OOM policy"),
    Pattern("X007", "LOKi SIGABRT frame 0", r"signal 6 .SIGABRT.*loki|SIGABRT.*#00.*loki", "critical", "LOKI", "LOKI_SEGFAULT_NULL_DEREF", 0.92, fix_hint="SIGABRT in LOKi – inspect abort() call site"),
    Pattern("X008", "WatchFree cross-layer", r"WatchFree.*LOKi.*deeplink|deeplink.*watchfree.*ipc", "high", "CROSS_LAYER", "WATCHFREE_DEEPLINK_LOSS", 0.9, cross_hint=True, fix_hint="Coordinate LOKi IPC + React hydration timing"),
    Pattern("X009", "Companion deadlock cross-layer", r"companion.*deadlock.*chromium|chromium.*companion.*hang", "critical", "CROSS_LAYER", "LOKI_COMPANION_SERVER_DEADLOCK", 0.92, cross_hint=True, fix_hint="Fix companion server async protocol"),
    Pattern("X010", "HDCP + Widevine correlation", r"HDCP.*fail.*widevine|widevine.*fail.*HDCP", "critical", "MEDIATEK", "MTK_HDCP_FAILURE", 0.9, fix_hint="Verify HDCP 2.2 + Widevine L1 stack"),
]
