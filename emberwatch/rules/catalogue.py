"""The shipped detection rules as data.

Fixed values: ids, severities, techniques, titles and match values. A rule maps
`field|operator[|not]` to one value or a list of alternatives; a lower-case
field is a promoted attribute, any other name is a raw payload key.
"""

from __future__ import annotations

STAGING = [r"\\users\\[^\\]+\\appdata\\", r"\\users\\public\\", r"\\windows\\temp\\", r"\\programdata\\"]
STAGED_EXE = [r"\\users\\[^\\]+\\appdata\\local\\temp\\", r"\\users\\public\\",
              r"\\windows\\temp\\[^\\]+\.exe", r"\\programdata\\[^\\]+\.exe"]
POWERSHELLS = [r"\powershell.exe", r"\pwsh.exe"]
SHELLS = [r"\cmd.exe", r"\powershell.exe", r"\pwsh.exe", r"\wscript.exe", r"\cscript.exe", r"\mshta.exe"]
FILE_SCRIPTERS = [r"\powershell.exe", r"\cmd.exe", r"\wscript.exe", r"\cscript.exe", r"\rundll32.exe"]
ARCHIVERS = [r"\7z.exe", r"\7za.exe", r"\winrar.exe", r"\rar.exe"]
TRUSTED_NAMES = ["CALC.EXE", "NOTEPAD.EXE", "CMD.EXE", "EXPLORER.EXE", "MSPAINT.EXE", "WERFAULT.EXE",
                 "SVCHOST.EXE", "IEXPLORE.EXE", "WINWORD.EXE", "EXCEL.EXE", "CHROME.EXE", "CONHOST.EXE"]
C2_PIPES = [r"\\msagent_[0-9a-f]{2}\b", r"\\status_[0-9a-f]{2}\b", r"\\postex_[0-9a-f]{4}\b",
            r"\\msf-pipe\b", r"\\(interprocess|windows\.update)_[0-9a-f]+"]
REMOTE_EXEC_PIPES = [r"\\psexesvc", r"\\remcom_communicat"]
HEX_PIPE = r"^\\[0-9a-f]{16,40}$"
RMM = r"anydesk|teamviewer|screenconnect|connectwisecontrol|rustdesk|ateraagent|splashtop|logmein"

# (id, event id, severity, condition, techniques, title, detection)
RULES = [
    ("SYS-001", 1, "high", "all", ("T1566.001", "T1059"), "Office application spawned a command interpreter",
     {"parent_image|endswith": [r"\winword.exe", r"\excel.exe", r"\powerpnt.exe", r"\outlook.exe"],
      "image|endswith": SHELLS}),
    ("SYS-002", 1, "high", "all", ("T1059.001", "T1027"), "PowerShell executed an encoded command",
     {"image|endswith": r"\powershell.exe", "command_line|re": r"\s-e(nc|ncodedcommand)?\s+[a-z0-9+/=]{20,}"}),
    ("SYS-003", 1, "high", "all", ("T1105", "T1218"), "LOLBin used to download a remote payload",
     {"command_line|re": [r"\bcertutil\b.*urlcache.*\bhttp", r"\bcertutil\b.*(verifyctl|split).*\bhttp",
                          r"\bbitsadmin\b.*transfer", r"\bmshta\b.*\bhttp", r"\bregsvr32\b.*/i:http"]}),
    ("SYS-004", 1, "critical", "all", ("T1490",), "Volume shadow copies deleted",
     {"command_line|re": [r"\bvssadmin\b.*\bdelete\b.*\bshadows\b", r"\bwmic\b.*\bshadowcopy\b.*\bdelete\b",
                          r"\bwbadmin\b.*\bdelete\b.*\b(catalog|systemstatebackup)\b",
                          r"\bbcdedit\b.*\b(recoveryenabled\s+no|bootstatuspolicy\s+ignoreallfailures)\b"]}),
    ("SYS-005", 1, "high", "all", ("T1204.002", "T1566"), "Script engine spawned from a browser or mail client",
     {"parent_image|endswith": [r"\outlook.exe", r"\chrome.exe", r"\msedge.exe", r"\firefox.exe", r"\acrord32.exe"],
      "image|endswith": SHELLS}),
    ("SYS-006", 1, "medium", "all", ("T1204",), "Executable ran from a user-writable staging path",
     {"image|re": STAGED_EXE}),
    ("SYS-007", 1, "high", "all", ("T1036.005",), "System binary running from the wrong path",
     {"image|endswith": [r"\svchost.exe", r"\lsass.exe", r"\services.exe", r"\csrss.exe", r"\winlogon.exe"],
      "image|re|not": [r"\\windows\\(system32|syswow64)\\"]}),
    ("SYS-008", 1, "medium", "all", ("T1218.011",), "rundll32 executed without a DLL argument",
     {"image|endswith": r"\rundll32.exe", "command_line|re|not": [r"\.dll\b", r"\.cpl\b"]}),
    ("SYS-009", 1, "high", "all", ("T1059.001", "T1105"), "PowerShell download cradle",
     {"image|endswith": POWERSHELLS,
      "command_line|re": r"\b(iex|invoke-expression)\b|\b(downloadstring|downloadfile|downloaddata)\b"
                         r"|\bnew-object\b.*\bnet\.webclient\b|\binvoke-webrequest\b|\biwr\b"}),
    ("SYS-010", 10, "critical", "all", ("T1003.001",), "Suspicious process accessed LSASS memory",
     {"TargetImage|endswith": r"\lsass.exe", "GrantedAccess": ["0x1010", "0x1410", "0x143a"]}),
    ("SYS-020", 3, "medium", "all", ("T1071",), "Scripting or LOLBin process made an outbound connection",
     {"image|endswith": [r"\powershell.exe", r"\pwsh.exe", r"\mshta.exe", r"\rundll32.exe", r"\regsvr32.exe",
                         r"\wscript.exe", r"\cscript.exe", r"\certutil.exe"]}),
    ("SYS-021", 3, "medium", "all", ("T1571",), "Connection to a common C2 port from a non-browser process",
     {"DestinationPort": ["4444", "1337", "8443", "9001", "31337", "5555"],
      "image|endswith|not": [r"\chrome.exe", r"\msedge.exe", r"\firefox.exe"]}),
    ("SYS-030", 13, "high", "all", ("T1547.001",), "Autorun registry key modified",
     {"TargetObject|re": [r"\\currentversion\\run\b", r"\\currentversion\\runonce\b",
                          r"\\currentversion\\policies\\explorer\\run\b"]}),
    ("SYS-031", 13, "high", "all", ("T1685",), "Windows Defender setting disabled via registry",
     {"TargetObject|re": [r"\\windows defender\\.*\\(disableantispyware|disablerealtimemonitoring)\b",
                          r"\\windows defender\\exclusions\\", r"\\policies\\microsoft\\windows defender\\"]}),
    ("SYS-032", 13, "high", "all", ("T1546.012",), "Image File Execution Options debugger set",
     {"TargetObject|re": r"\\image file execution options\\.*\\debugger\b"}),
    ("SYS-034", 1, "high", "all", ("T1218.002",), "Control panel item (.cpl) executed from a user-writable path",
     {"image|endswith": [r"\control.exe", r"\rundll32.exe"],
      "command_line|re": [r"\.cpl.{0,3}$", r"""\.cpl["']?,"""],
      "command_line|re|not": [r"\\(system32|syswow64)\\[^\\]+\.cpl"]}),
    ("SYS-035", 1, "high", "all", ("T1059.005", "T1059.007", "T1027"), "Script host executing an encoded script",
     {"image|endswith": [r"\wscript.exe", r"\cscript.exe"], "command_line|re": r"/e:(jscript|vbscript)\.encode"}),
    ("SYS-036", 1, "high", "all", ("T1059", "T1218.011"), "Script host spawned by rundll32",
     {"parent_image|endswith": r"\rundll32.exe",
      "image|endswith": [r"\wscript.exe", r"\cscript.exe", r"\powershell.exe", r"\mshta.exe"]}),
    ("SYS-037", 1, "high", "all", ("T1218.011", "T1204.001"), "rundll32 invoking a known LOLBAS DLL export",
     {"image|endswith": r"\rundll32.exe",
      "command_line|re": [r"\b(url|ieframe|shdocvw)\.dll\s*,\s*(openurl|fileprotocolhandler)",
                          r"\bzipfldr\.dll\s*,\s*routethecall",
                          r"\badvpack\.dll\s*,\s*(registerocx|launchinfsection)",
                          r"\bpcwutl\.dll\s*,\s*launchapplication"]}),
    ("SYS-038", 1, "high", "all", ("T1552.001", "T1003"), "IIS credentials extracted via appcmd",
     {"image|endswith": r"\appcmd.exe",
      "command_line|re": [r"/text:.*(password|username)",
                          r"list\s+(apppool|vdir|config).*processmodel\.(password|username)"]}),
    ("SYS-039", 1, "medium", "all", ("T1552.001",), "appcmd executed by a web server worker or script host",
     {"image|endswith": r"\appcmd.exe",
      "parent_image|endswith": [r"\w3wp.exe", r"\powershell.exe", r"\pwsh.exe", r"\cmd.exe"]}),
    ("SYS-040", 7, "high", "all", ("T1059.001",), "PowerShell engine loaded by a non-PowerShell process",
     {"ImageLoaded|endswith": [r"\system.management.automation.dll", r"\system.management.automation.ni.dll"],
      "Image|endswith|not": [r"\powershell.exe", r"\pwsh.exe", r"\powershell_ise.exe"]}),
    ("SYS-041", 10, "critical", "all", ("T1003.001",), "LSASS opened with credential-dumping access rights",
     {"TargetImage|endswith": r"\lsass.exe",
      "GrantedAccess": ["0x1010", "0x1410", "0x143a", "0x1438", "0x1fffff"]}),
    ("SYS-050", 11, "high", "all", ("T1547.001",), "File dropped into a Startup folder",
     {"TargetFilename|re": r"\\start menu\\programs\\startup\\"}),
    ("SYS-051", 11, "high", "all", ("T1566.001",), "Office application wrote a script or executable",
     {"Image|endswith": [r"\winword.exe", r"\excel.exe", r"\powerpnt.exe", r"\outlook.exe"],
      "TargetFilename|re": r"\.(exe|dll|ps1|vbs|js|hta|scr|bat|lnk)$"}),
    ("SYS-060", 17, "high", "all", ("T1071", "T1055"), "Named pipe matching a known C2 default", {"PipeName|re": C2_PIPES}),
    ("SYS-070", 1, "medium", "all", ("T1546.003",), "WMI persistence staged via mofcomp or wmic",
     {"command_line|re": [r"\bmofcomp\b.*\.mof\b", r"\bwmic\b.*root\\subscription.*\bcreate\b"]}),
    ("SYS-071", 20, "high", "all", ("T1546.003",), "WMI event consumer registered for code execution",
     {"Type|equals": ["Command Line", "Script"]}),
    ("SYS-072", 17, "high", "all", ("T1021.002", "T1569.002"), "Named pipe matching PsExec-style remote execution",
     {"PipeName|re": REMOTE_EXEC_PIPES}),
    ("SYS-073", 1, "high", "any", ("T1569.002", "T1021.002"), "PsExec service binary executed on this host",
     {"image|endswith": r"\PSEXESVC.exe", "command_line|contains": "-accepteula"}),
    ("SYS-074", 1, "high", "all", ("T1218.010",), "Regsvr32 registering a scriptlet via scrobj.dll (Squiblydoo)",
     {"image|endswith": r"\regsvr32.exe", "command_line|contains": "scrobj.dll"}),
    ("SYS-075", 1, "medium", "all", ("T1140",), "Certutil used to decode or encode a local file",
     {"image|endswith": r"\certutil.exe", "command_line|re": r"-(de|en)code\b"}),
    ("SYS-076", 1, "medium", "all", ("T1197",), "BITS job created via the Start-BitsTransfer cmdlet",
     {"image|endswith": r"\powershell.exe", "command_line|contains": "Start-BitsTransfer"}),
    ("SYS-077", 6, "high", "all", ("T1211", "T1562.001"), "Unsigned kernel driver loaded", {"Signed|equals": "false"}),
    ("SYS-078", 13, "high", "all", ("T1047", "T1547.001"), "Registry Run key written by the WMI provider host",
     {"image|endswith": r"\wmiprvse.exe", "TargetObject|contains": r"\CurrentVersion\Run"}),
    ("SYS-079", 1, "high", "all", ("T1105", "T1202"), "FTP client spawned a child process",
     {"parent_image|endswith": r"\ftp.exe"}),
    ("SYS-080", 11, "critical", "all", ("T1486", "T1491.001"), "Ransom note dropped",
     {"TargetFilename|re": r"(?i)(how.?to.?(decrypt|recover|restore)|decrypt.?(instructions|files)|restore.?files"
                           r"|recovery.?instructions|your.?files.?(are.?)?encrypted|_readme\.(txt|html|hta))"}),
    ("SYS-081", 11, "critical", "all", ("T1486",), "File written with a known ransomware encryption extension",
     {"TargetFilename|endswith": [".locked", ".encrypted", ".crypt", ".crypted", ".locky", ".cerber", ".wcry",
                                  ".wncry"]}),
    ("SYS-082", 1, "critical", "all", ("T1003.001",), "Credential dumping via comsvcs.dll MiniDump export",
     {"image|endswith": r"\rundll32.exe", "command_line|re": r"\bcomsvcs\.dll\s*,\s*minidump\b"}),
    ("SYS-083", 13, "high", "all", ("T1548.002",), "Fileless UAC bypass via auto-elevate registry hijack",
     {"TargetObject|re": [r"\\shell\\(open|runas)\\command\\(isolatedcommand|\(default\))$",
                          r"\\currentversion\\app paths\\[^\\]+\\\(default\)$"]}),
    ("SYS-084", 1, "high", "all", ("T1218.003",), "cmstp executed with a silent or auto-install flag",
     {"image|endswith": r"\cmstp.exe", "command_line|re": r"\s/(s|au)\b"}),
    ("SYS-085", 13, "high", "all", ("T1090.001",), "Port forwarding rule added via netsh",
     {"image|endswith": r"\netsh.exe", "TargetObject|contains": "\\PortProxy\\"}),
    ("SYS-086", 13, "high", "all", ("T1562.001",), "PowerShell script block logging disabled via registry",
     {"TargetObject|re": [r"\\powershell\\scriptblocklogging\\", r"\\powershell\\transcription\\"]}),
    ("SYS-087", 12, "high", "all", ("T1562.001",), "PowerShell Constrained Language Mode lockdown policy removed",
     {"EventType|equals": "DeleteValue", "TargetObject|contains": "__PSLockdownPolicy"}),
    ("SYS-088", 1, "critical", "all", ("T1505.003",), "IIS worker process spawned a command shell",
     {"parent_image|endswith": r"\w3wp.exe",
      "image|endswith": [r"\cmd.exe", r"\powershell.exe", r"\pwsh.exe", r"\cscript.exe", r"\wscript.exe"]}),
    ("SYS-089", 1, "critical", "all", ("T1059.003", "T1190"), "SQL Server process spawned a command shell",
     {"parent_image|endswith": r"\sqlservr.exe", "image|endswith": [r"\cmd.exe", r"\powershell.exe", r"\pwsh.exe"]}),
    ("SYS-090", 1, "medium", "all", ("T1021.006",), "Process spawned by the PowerShell remoting host",
     {"parent_image|endswith": r"\wsmprovhost.exe"}),
    ("SYS-091", 13, "medium", "all", ("T1136.001", "T1098"),
     "Local account or administrators-group membership changed in the SAM hive",
     {"image|endswith": r"\lsass.exe",
      "TargetObject|contains": ["\\SAM\\Domains\\Account\\Users\\Names\\", "\\SAM\\Domains\\Builtin\\Aliases\\"]}),
    ("SYS-092", 1, "high", "all", ("T1036.005",),
     "PE metadata claims a trusted binary, but it runs from a staging path",
     {"OriginalFileName": TRUSTED_NAMES, "image|re": STAGED_EXE}),
    ("SYS-093", 1, "high", "all", ("T1053.005",), "Scheduled task created via schtasks",
     {"image|endswith": r"\schtasks.exe", "command_line|contains": "/create"}),
    ("SYS-094", 13, "high", "all", ("T1543.003",), "New service image path points at a user-writable staging location",
     {"TargetObject|re": r"\\services\\[^\\]+\\imagepath$", "Details|re": STAGING}),
    ("SYS-095", 8, "critical", "all", ("T1055", "T1003.001"), "Remote thread created inside LSASS",
     {"TargetImage|endswith": r"\lsass.exe"}),
    ("SYS-096", 1, "high", "all", ("T1562.004",), "Firewall rule added to allow inbound traffic",
     {"image|endswith": r"\netsh.exe",
      "command_line|re": r"(?=.*advfirewall)(?=.*\badd\b)(?=.*\brule\b)(?=.*action=allow)"}),
    ("SYS-097", 1, "high", "all", ("T1070.001",), "Windows event log cleared via wevtutil",
     {"image|endswith": r"\wevtutil.exe", "command_line|re": r"(?<!\S)cl(?!\S)"}),
    ("SYS-098", 1, "medium", "all", ("T1560.001",),
     "Archive utility invoked with a password, staging data for exfiltration",
     {"image|endswith": [r"\rar.exe", r"\winrar.exe", r"\7z.exe", r"\7za.exe"],
      "command_line|re": r"(?<!\S)-p\S"}),
    ("SYS-099", 1, "high", "all", ("T1218.004", "T1218.009"),
     ".NET installer utility executed from a user-writable staging path",
     {"image|endswith": [r"\installutil.exe", r"\regsvcs.exe", r"\regasm.exe"], "command_line|re": STAGING}),
    ("SYS-100", 1, "high", "all", ("T1218.005",), "mshta executed a remote HTA",
     {"image|endswith": r"\mshta.exe", "command_line|re": r"https?://"}),
    ("SYS-101", 1, "medium", "all", ("T1218.001",), "Compiled HTML Help opened from a user-writable staging path",
     {"image|endswith": r"\hh.exe", "command_line|re": STAGING}),
    ("SYS-102", 1, "high", "all", ("T1218.007",), "msiexec installed a package from a remote URL",
     {"image|endswith": r"\msiexec.exe", "command_line|re": r"https?://"}),
    ("SYS-103", 1, "medium", "all", ("T1098", "T1136.001"), "Account added to the local Administrators group via net.exe",
     {"image|endswith": [r"\net.exe", r"\net1.exe"],
      "command_line|re": r"(?=.*\blocalgroup\b)(?=.*\badministrators\b)(?=.*\badd\b)"}),
    ("SYS-104", 1, "high", "all", ("T1489", "T1562.001"),
     "A security or update service was stopped from the command line",
     {"image|endswith": [r"\sc.exe", r"\net.exe", r"\net1.exe"],
      "command_line|re": r"(?=.*\bstop\b)(?=.*(windefend|\bsense\b|wuauserv|mbamservice|webrootsvc))"}),
    ("SYS-105", 1, "high", "all", ("T1070.004",), "Sysinternals sdelete executed",
     {"image|endswith": [r"\sdelete.exe", r"\sdelete64.exe"]}),
    ("SYS-106", 1, "medium", "all", ("T1070.004",), "cipher used to wipe free disk space",
     {"image|endswith": r"\cipher.exe", "command_line|contains": "/w:"}),
    ("SYS-107", 13, "medium", "all", ("T1021.001",), "Remote Desktop enabled via registry",
     {"TargetObject|contains": r"Terminal Server\fDenyTSConnections", "Details|equals": "DWORD (0x00000000)"}),
    ("SYS-108", 1, "critical", "all", ("T1003.002",), "Credential hive saved to disk via reg.exe",
     {"image|endswith": r"\reg.exe", "command_line|re": r"(?=.*\bsave\b)(?=.*hklm\\(sam|system|security)\b)"}),
    ("SYS-109", 1, "critical", "all", ("T1003.001",), "Sysinternals procdump run against LSASS",
     {"image|endswith": [r"\procdump.exe", r"\procdump64.exe"], "command_line|contains": "lsass"}),
    ("SYS-110", 1, "critical", "all", ("T1003.003",), "NTDS.dit extracted via ntdsutil",
     {"image|endswith": r"\ntdsutil.exe", "command_line|re": r"(?=.*\bifm\b)(?=.*\bcreate\b)"}),
    ("SYS-111", 1, "high", "all", ("T1055.001",), "mavinject used to inject into a running process",
     {"image|endswith": r"\mavinject.exe", "command_line|contains": "/injectrunning"}),
    ("SYS-112", 1, "medium", "all", ("T1202", "T1059.004"),
     "WSL used to execute a command outside its Linux filesystem",
     {"image|endswith": r"\wsl.exe", "command_line|re": r"(?<!\S)(-e|--exec)(?!\S)"}),
    ("SYS-113", 1, "high", "all", ("T1127.001",), "MSBuild ran a project file staged in a user-writable path",
     {"image|endswith": r"\msbuild.exe", "command_line|re": STAGING}),
    ("SYS-114", 1, "medium", "all", ("T1218", "T1216"),
     "Uncommon signed proxy-execution binary run against a staged target",
     {"image|endswith": [r"\forfiles.exe", r"\pcalua.exe", r"\verclsid.exe", r"\register-cimprovider.exe"],
      "command_line|re": STAGING}),
    ("SYS-115", 1, "high", "all", ("T1563.002",), "RDP session hijacked via tscon",
     {"image|endswith": r"\tscon.exe", "command_line|contains": "/dest:"}),
    ("SYS-116", 1, "high", "all", ("T1087", "T1482"), "Active Directory reconnaissance tool executed",
     {"image|endswith": [r"\sharphound.exe", r"\adfind.exe"]}),
    ("SYS-117", 1, "medium", "all", ("T1567.002",), "Cloud sync/transfer tool executed",
     {"image|endswith": [r"\rclone.exe", r"\mega.exe", r"\megacmd.exe", r"\megasync.exe"]}),
    ("SYS-118", 1, "high", "any", ("T1558.003",), "Kerberoasting tooling executed",
     {"image|endswith": r"\rubeus.exe", "command_line|contains": "kerberoast"}),
    ("SYS-119", 1, "high", "all", ("T1059.001",), "PowerShell launched in version-2 downgrade mode",
     {"image|endswith": r"\powershell.exe", "command_line|contains": "-version 2"}),
    ("SYS-120", 1, "high", "all", ("T1562.001",), "Command line references a known AMSI-bypass signature",
     {"command_line|contains": ["amsiutils", "amsiinitfailed"]}),
    ("SYS-121", 1, "medium", "all", ("T1197",), "bitsadmin used to transfer a file",
     {"image|endswith": r"\bitsadmin.exe", "command_line|contains": "/transfer"}),
    ("SYS-122", 13, "high", "all", ("T1546.015",), "CLSID InprocServer32 handler registered under a user's own hive",
     {"TargetObject|contains": "\\Classes\\CLSID\\", "TargetObject|endswith": r"\InprocServer32\(Default)"}),
    ("SYS-123", 1, "high", "all", ("T1134",), "Command line references a known privilege-escalation token-theft tool",
     {"command_line|contains": ["incognito", "godpotato", "juicypotato", "printspoofer"]}),
    ("SYS-124", 22, "medium", "any", ("T1071.004", "T1568"), "DNS query to a dynamic DNS domain",
     {"QueryName|contains": [".duckdns.org", ".no-ip.org", ".no-ip.com", ".no-ip.biz", ".ddns.net", ".dynu.com",
                             ".dynu.net", ".hopto.org", ".zapto.org", ".myftp.org", ".serveftp.com",
                             ".servehttp.com", ".changeip.com"]}),
    ("SYS-125", 23, "medium", "all", ("T1070.004",), "Executable deleted from a staging path shortly after being dropped",
     {"IsExecutable|equals": "true",
      "TargetFilename|re": [r"\\appdata\\local\\temp\\", r"\\windows\\temp\\", r"\\users\\public\\",
                            r"\\programdata\\"]}),
    ("SYS-126", 25, "critical", "any", ("T1055.012", "T1055.013"),
     "Process image tampering detected (hollowing or doppelganging)",
     {"Type": ["Image is locked for access", "Process Doppelganging"]}),
    ("SYS-127", 15, "high", "any", ("T1564.004",), "Executable content staged inside an NTFS alternate data stream",
     {"TargetFilename|re": r":[^\\/:]+\.(exe|dll|ps1|bat|vbs|hta|scr|cmd)$"}),
    ("SYS-128", 9, "high", "all", ("T1006",), "Raw volume access by a process outside known disk utilities",
     {"Device|contains": "HarddiskVolume",
      "image|endswith|not": [r"\vssadmin.exe", r"\wbadmin.exe", r"\defrag.exe", r"\chkdsk.exe", r"\dfrgui.exe"]}),
    ("SYS-129", 2, "medium", "all", ("T1070.006",), "File creation timestamp changed outside a servicing process",
     {"image|endswith|not": [r"\msiexec.exe", r"\trustedinstaller.exe", r"\tiworker.exe"]}),
    ("SYS-130", 1, "critical", "any", ("T1003.006",), "DCSync-style directory replication requested from a command line",
     {"command_line|contains": ["lsadump::dcsync", "dcsync", "getncchanges", "invoke-dcsync"]}),
    ("SYS-131", 1, "critical", "any", ("T1003.001",), "Command line references a known Mimikatz module or command",
     {"command_line|contains": ["sekurlsa::logonpasswords", "sekurlsa::pth", "lsadump::sam", "kerberos::ptt",
                                "invoke-mimikatz"]}),
    ("SYS-132", 1, "high", "all", ("T1218.008",), "Odbcconf used as a signed proxy-execution binary",
     {"image|endswith": r"\odbcconf.exe", "command_line|re": [r"/a\s*\{", r"\bregsvr\b", r"\binstalldriver\b"]}),
    ("SYS-133", 1, "high", "all", ("T1218.014",), "mmc.exe loaded a Management Saved Console from a staging path",
     {"image|endswith": r"\mmc.exe",
      "command_line|re": [r"\\appdata\\[^ ]*\.msc", r"\\temp\\[^ ]*\.msc", r"\\downloads\\[^ ]*\.msc",
                          r"\\desktop\\[^ ]*\.msc", r"\\programdata\\[^ ]*\.msc"]}),
    ("SYS-136", 11, "high", "all", ("T1555",), "Script interpreter touched a KeePass database",
     {"TargetFilename|endswith": ".kdbx", "image|endswith": FILE_SCRIPTERS}),
    ("SYS-137", 11, "high", "all", ("T1555.003",), "Browser credential database written into a staging directory",
     {"TargetFilename|contains": ["\\Temp\\", "\\Downloads\\", "\\ProgramData\\"],
      "TargetFilename|endswith": ["Login Data", "Cookies", "Web Data"]}),
    ("SYS-138", 1, "medium", "any", ("T1016",), "Network configuration discovery command executed",
     {"command_line|re": [r"\bipconfig\b", r"\barp\s+-a\b", r"\broute\s+print\b", r"\bnetsh\s+interface\b"]}),
    ("SYS-139", 1, "medium", "all", ("T1049",), "Active network connections enumerated via netstat",
     {"image|endswith": r"\netstat.exe", "command_line|contains": ["-ano", "-anob"]}),
    ("SYS-140", 1, "medium", "any", ("T1083",), "Recursive filesystem enumeration executed",
     {"command_line|re": [r"\bdir\s+/s\b", r"\btree\b", r"get-childitem\s+-recurse"]}),
    ("SYS-141", 1, "high", "all", ("T1518.001",), "Security or EDR product enumerated from the command line",
     {"command_line|re": r"(?=.*\b(wmic\s+product|get-ciminstance|tasklist|sc\s+query)\b)"
                         r"(?=.*\b(defender|sentinelone|crowdstrike|carbon\s*black|cylance|sophos|trend\s*micro"
                         r"|trellix|mcafee)\b)"}),
    ("SYS-142", 1, "medium", "all", ("T1560.001",), "Archive created with its header/file-list encrypted",
     {"image|endswith": ARCHIVERS, "command_line|contains": "-mhe"}),
    ("SYS-143", 1, "high", "all", ("T1567.002",), "Rclone ran a copy/sync against a remote destination",
     {"image|endswith": r"\rclone.exe",
      "command_line|re": r"\b(copy|sync|move)\b.*\b[A-Za-z][\w.-]*:(?![\\/])\S+"}),
    ("SYS-144", 1, "high", "any", ("T1048",), "Command-line tooling uploaded a file to a remote server",
     {"command_line|re": [r"curl(\.exe)?\s.*(-t\s|--upload-file)",
                          r"(invoke-webrequest|invoke-restmethod)\b.*-infile\b"]}),
    ("SYS-148", 1, "high", "any", ("T1482",), "SharpHound invoked via script or named by its collection arguments",
     {"command_line|re": [r"sharphound\.ps1", r"invoke-bloodhound", r"-{1,2}collectionmethod"]}),
    ("SYS-149", 1, "medium", "any", ("T1087",), "Active Directory account or group enumeration command executed",
     {"command_line|re": [r"\bnet\d?\s+(user|group)\b", r"\bnltest\b", r"\bdsquery\b"]}),
    ("SYS-150", 1, "high", "any", ("T1558.004",), "AS-REP roasting tooling executed",
     {"command_line|contains": ["getnpusers", "asreproast", "asrep"]}),
    ("SYS-151", 1, "high", "all", ("T1204.004", "T1204.001"), "ClickFix/FileFix decoy verification lure pasted from Explorer",
     {"parent_image|endswith": r"\explorer.exe",
      "command_line|re": r"(?=.*#)(?=.*\b(?:account|anti-?bot|botcheck|captcha|challenge|confirmation|fraud|human"
                         r"|identification|identity|not\s+a\s+robot|robot|validation|verification|verify)\b)"}),
    ("SYS-152", 1, "high", "all", ("T1204.004", "T1059.001"),
     "PowerShell launched from Explorer with execution-policy bypass and a hidden window",
     {"parent_image|endswith": r"\explorer.exe", "image|endswith": POWERSHELLS,
      "command_line|re": r"(?=.*-(?:ep|executionpolicy)\s+bypass)(?=.*-(?:w|windowstyle)\s+hidden)"}),
    ("SYS-153", 1, "high", "all", ("T1204.004", "T1105"), "Script host launched from Explorer immediately fetching remote code",
     {"parent_image|endswith": r"\explorer.exe",
      "image|endswith": [r"\powershell.exe", r"\pwsh.exe", r"\cmd.exe", r"\mshta.exe", r"\wscript.exe",
                         r"\cscript.exe"],
      "command_line|re": r"https?://|\b(?:iex|invoke-expression|invoke-webrequest|iwr)\b|downloadstring"
                         r"|downloadfile|downloaddata|curl(?:\.exe)?\s+-o|certutil[^\n]*-urlcache"
                         r"|bitsadmin[^\n]*\/transfer"}),
    ("SYS-154", 1, "high", "all", ("T1204.004", "T1059.001"), "PowerShell reads and executes clipboard contents",
     {"image|endswith": POWERSHELLS, "command_line|re": r"\b(?:get-clipboard|gcb)\b"}),
    ("SYS-155", 1, "high", "all", ("T1219",),
     "Remote-access/RMM software launched by a script or document, not a user double-click",
     {"image|re": RMM + "|quickassist", "parent_image|endswith|not": r"\explorer.exe"}),
    ("SYS-156", 1, "high", "all", ("T1219",), "Remote-access/RMM software installed with unattended/silent flags",
     {"image|re": RMM,
      "command_line|re": r"(?:^|[\s/-])(?:-{1,2}silent|-{1,2}verysilent|/s\b|/qn\b|/quiet\b|--start-with-win)"}),
    ("SYS-157", 1, "high", "all", ("T1115",), "PowerShell reads and overwrites the clipboard in the same command",
     {"image|endswith": POWERSHELLS,
      "command_line|re": r"(?=.*\b(?:get-clipboard|gcb)\b)(?=.*\b(?:set-clipboard|scb)\b)"}),
    ("SYS-158", 1, "high", "all", ("T1113",), "Problem Steps Recorder (psr.exe) invoked to silently capture screenshots",
     {"image|endswith": r"\psr.exe", "command_line|contains": "/start"}),
    ("SYS-159", 1, "high", "any", ("T1102",), "Chat-service webhook or bot API used as a covert channel",
     {"command_line|re": r"discord(?:app)?\.com/api/(?:v\d+/)?webhooks/|api\.telegram\.org/bot"
                         r"|hooks\.slack\.com/services/"}),
    ("SYS-160", 1, "high", "any", ("T1102",), "Public paste service used as a C2 dead-drop",
     {"command_line|re": r"(?=.*(?:pastebin\.com/raw|hastebin\.com/raw|gist\.githubusercontent\.com))"
                         r"(?=.*\b(?:iex|invoke-expression|invoke-webrequest|iwr|downloadstring|downloadfile)\b)"}),
    ("SYS-161", 1, "medium", "all", ("T1074",), "Archive utility packaged a broad user data directory",
     {"image|endswith": ARCHIVERS, "command_line|re": r"\\(?:documents|desktop|pictures|users)\\"}),
    ("SYS-162", 1, "medium", "all", ("T1119", "T1074"), "robocopy mass-mirrored a broad user directory tree",
     {"image|endswith": r"\robocopy.exe",
      "command_line|re": r"(?=.*(?:/mir\b|/e\b))(?=.*\\(?:documents|desktop|users)\\)"}),
    ("SYS-163", 1, "critical", "all", ("T1550.003",), "Rubeus used to pass or renew a Kerberos ticket",
     {"image|endswith": r"\rubeus.exe", "command_line|re": r"\b(?:ptt|renew)\b"}),
    ("SYS-164", 1, "critical", "any", ("T1550.002", "T1550.003"), "Mimikatz used to pass a hash or a Kerberos ticket",
     {"command_line|re": r"sekurlsa::pth|kerberos::ptt"}),
    ("SYS-165", 1, "critical", "any", ("T1484.001",), "Known Group Policy abuse tooling or cmdlet invoked",
     {"command_line|re": r"sharpgpoabuse|new-gpoimmediatetask|set-gppregistryvalue"}),
    ("SYS-166", 1, "critical", "all", ("T1484.002",), "Domain trust modified to disable SID-filtering protections",
     {"image|endswith": r"\netdom.exe", "command_line|re": r"(?=.*\btrust\b)(?=.*(?:quarantine:no|sidhistory:yes))"}),
    ("SYS-167", 1, "critical", "any", ("T1485",), "Command-line destructive wipe of a broad user directory or volume",
     {"command_line|re": r"\bformat(?:\.com)?\s+[a-z]:.*\s/y\b"
                         r"|(?=.*\bdel\b)(?=.*/f\b)(?=.*/s\b)(?=.*/q\b)(?=.*\\(?:documents|desktop|users)\\)"
                         r"|(?=.*remove-item\b)(?=.*-recurse\b)(?=.*-force\b)(?=.*\\(?:documents|desktop|users)\\)"}),
    ("SYS-168", 1, "critical", "any", ("T1531",), "PowerShell bulk-disabled or reset a broad set of AD accounts",
     {"command_line|re": r"(?=.*get-aduser\b)(?=.*-filter\b)"
                         r"(?=.*(?:disable-adaccount|set-adaccountpassword|remove-adgroupmember))"}),
    ("SYS-171", 11, "high", "all", ("T1552.004",), "Script interpreter staged an SSH or PuTTY private key",
     {"TargetFilename|endswith": [r"\id_rsa", r"\id_ed25519", r"\id_ecdsa", ".ppk"],
      "image|endswith": FILE_SCRIPTERS}),
    ("SYS-172", 1, "high", "all", ("T1047",), "WMI used to create a process via Win32_Process",
     {"image|endswith": [r"\wmic.exe", r"\powershell.exe", r"\pwsh.exe"],
      "command_line|re": r"(?=.*\bprocess\b)(?=.*\bcall\b)(?=.*\bcreate\b)|(?=.*win32_process)(?=.*\bcreate\b)"}),
    ("SYS-173", 1, "high", "all", ("T1021.003",), "mmc.exe spawned a shell consistent with MMC20.Application DCOM abuse",
     {"parent_image|endswith": r"\mmc.exe",
      "image|endswith": [r"\cmd.exe", r"\powershell.exe", r"\pwsh.exe", r"\cscript.exe", r"\wscript.exe",
                         r"\rundll32.exe"]}),
    ("SYS-174", 1, "high", "all", ("T1611",), "Docker container launched with --privileged",
     {"command_line|re": r"(?=.*\bdocker(?:\.exe)?\b)(?=.*\brun\b)(?=.*--privileged\b)"}),
    ("SYS-175", 11, "critical", "all", ("T1546.008",), "Accessibility binary replaced on disk",
     {"TargetFilename|endswith": [r"\sethc.exe", r"\utilman.exe", r"\osk.exe", r"\magnify.exe", r"\narrator.exe",
                                  r"\displayswitch.exe", r"\atbroker.exe"],
      "image|endswith": FILE_SCRIPTERS + [r"\certutil.exe"]}),
    ("SYS-176", 13, "high", "all", ("T1547.004",), "Winlogon helper DLL persistence key set",
     {"TargetObject|re": r"\\winlogon\\(notify|userinit|shell)\b"}),
    ("SYS-177", 13, "high", "all", ("T1547.005",), "Security Support Provider registered",
     {"TargetObject|re": r"\\control\\lsa\\(osconfig\\)?security packages\b"}),
    ("SYS-178", 13, "high", "all", ("T1547.014",), "Active Setup StubPath persistence key set",
     {"TargetObject|re": r"\\active setup\\installed components\\.*\\stubpath\b"}),
    ("SYS-179", 1, "high", "all", ("T1136.002",), "Domain account created",
     {"image|endswith": [r"\net.exe", r"\net1.exe", r"\powershell.exe", r"\pwsh.exe"],
      "command_line|re": r"(?=.*\buser\b)(?=.*/add\b)(?=.*/domain\b)|new-aduser"}),
    ("SYS-180", 1, "critical", "all", ("T1562.009",), "Boot configured into Safe Mode",
     {"image|endswith": r"\bcdedit.exe", "command_line|contains": "safeboot"}),
    ("SYS-181", 1, "high", "all", ("T1562.002",), "Windows Event Log service or channel disabled",
     {"image|endswith": [r"\sc.exe", r"\wevtutil.exe", r"\powershell.exe", r"\pwsh.exe"],
      "command_line|re": r"(?=.*\beventlog\b)(?=.*\b(stop|disabled)\b)|(?=.*\bsl\b)(?=.*/e:false)"}),
    ("SYS-182", 1, "high", "all", ("T1204.003",), "Disk image mounted via PowerShell",
     {"image|endswith": POWERSHELLS, "command_line|contains": "mount-diskimage"}),
    ("SYS-184", 1, "critical", "all", ("T1558.001",), "Mimikatz used to forge a Kerberos golden ticket",
     {"command_line|contains": "kerberos::golden"}),
    ("SYS-185", 11, "high", "all", ("T1036.007",), "File written with a double extension masking an executable",
     {"TargetFilename|re": r"\.(pdf|docx?|xlsx?|pptx?|txt|jpg|jpeg|png|zip)"
                           r"\.(exe|scr|cmd|bat|com|pif|js|vbs|jar|lnk)$"}),
    ("SYS-186", 1, "high", "all", ("T1552.002",), "Registry queried for an autologon or default password",
     {"image|endswith": r"\reg.exe",
      "command_line|re": r"(?=.*\bquery\b)(?=.*\bwinlogon\b)(?=.*(defaultpassword|altdefaultpassword))"}),
    ("SYS-187", 1, "critical", "all", ("T1552.006",), "Group Policy Preferences cpassword harvested",
     {"image|endswith": [r"\findstr.exe", r"\powershell.exe", r"\pwsh.exe", r"\cmd.exe"],
      "command_line|re": r"cpassword|get-gpppassword"}),
    ("SYS-188", 1, "high", "all", ("T1021.004",), "SSH client used with a private key for lateral movement",
     {"image|endswith": r"\ssh.exe", "command_line|re": r"(^|\s)-i(\s|$)"}),
    ("SYS-189", 1, "high", "any", ("T1090.003",), "Tor or a multi-hop proxy tool launched",
     {"image|endswith": r"\tor.exe", "command_line|contains": [".onion", "torsocks", "torify"]}),
    ("SYS-190", 1, "high", "all", ("T1560.002",), "PowerShell archived data using .NET compression, no archive tool on disk",
     {"image|endswith": POWERSHELLS, "command_line|contains": "system.io.compression"}),
    ("SYS-191", 16, "critical", "all", ("T1562.001", "T1562.006"), "Sysmon configuration reloaded",
     {"ConfigurationFileHash|re": ".+"}),
    ("SYS-192", 19, "high", "all", ("T1546.003",), "WMI event filter registered", {"Name|re": ".+"}),
    ("SYS-193", 21, "high", "all", ("T1546.003",), "WMI filter bound to a consumer", {"Consumer|re": ".+"}),
    ("SYS-194", 18, "high", "all", ("T1071", "T1055", "T1021.002", "T1569.002"),
     "Connection to a named pipe matching a known C2 or lateral-movement signature",
     {"PipeName|re": C2_PIPES + REMOTE_EXEC_PIPES}),
    ("SYS-195", 24, "medium", "all", ("T1115",), "Clipboard accessed by a scripting engine or LOLBIN",
     {"image|endswith": [r"\powershell.exe", r"\pwsh.exe", r"\cmd.exe", r"\wscript.exe", r"\cscript.exe",
                         r"\mshta.exe", r"\rundll32.exe"]}),
    ("SYS-196", 14, "high", "all", ("T1112", "T1564.001"), "Persistence-relevant registry key renamed",
     {"EventType|equals": "RenameKey",
      "TargetObject|re": r"\\run\b|\\runonce\b|\\image file execution options\b|\\winlogon\b|\\control\\lsa\b"
                         r"|\\active setup\\installed components\b"}),
    ("SYS-197", 7, "high", "all", ("T1574.001", "T1574.002"),
     "Unsigned DLL loaded from a user-writable path by a trusted-location process",
     {"Image|re": r"\\(system32|syswow64|program files)\\",
      "ImageLoaded|re": r"\\(temp|appdata|downloads|programdata|users\\public)\\", "Signed|equals": "false"}),
    ("SYS-198", 1, "high", "all", ("T1553.004",), "Certutil used to install a certificate into a trust store",
     {"image|endswith": r"\certutil.exe", "command_line|re": r"-addstore\b"}),
    ("SYS-199", 1, "high", "all", ("T1036.007", "T1204.002"), "Executable disguised as an installer package was run",
     {"image|re": r"\.(msi|msix|appx|pkg|dmg|apk)\.(exe|scr|cmd|bat|com|pif|js|vbs|jar|lnk)$"}),
    ("SYS-200", 1, "high", "all", ("T1548.002",),
     "UAC auto-elevate binary launched outside the normal Explorer prompt flow",
     {"Image|endswith": [r"\eventvwr.exe", r"\sysprep.exe", r"\cliconfg.exe", r"\mcx2prov.exe", r"\wusa.exe",
                         r"\dcomcnfg.exe", r"\computerdefaults.exe", r"\fodhelper.exe", r"\sdclt.exe",
                         r"\winsat.exe", r"\pkgmgr.exe", r"\dism.exe"],
      "IntegrityLevel|equals": "High", "ParentImage|endswith|not": [r"\explorer.exe", r"\svchost.exe"]}),
    ("SYS-201", 13, "critical", "all", ("T1548.002",), "Per-user %windir% environment variable set via registry",
     {"EventType|equals": "SetValue", "TargetObject|endswith": r"\Environment\windir"}),
    ("SYS-202", 7, "critical", "all", ("T1548.002", "T1574.001", "T1574.002"),
     "UAC auto-elevate binary loaded an unsigned DLL",
     {"Image|endswith": [r"\consent.exe", r"\sysprep.exe", r"\wusa.exe", r"\WerFault.exe", r"\cliconfg.exe",
                         r"\mcx2prov.exe", r"\winsat.exe", r"\eventvwr.exe"], "Signed|equals": "false"}),
    ("SYS-203", 13, "critical", "all", ("T1548.002", "T1562.001"), "UAC disabled via the EnableLUA registry value",
     {"EventType|equals": "SetValue", "TargetObject|endswith": r"\Policies\System\EnableLUA",
      "Details|equals": "DWORD (0x00000000)"}),
    ("SYS-204", 1, "critical", "all", ("T1548.002", "T1134.001"), "Shell spawned by DllHost.exe at High integrity",
     {"Image|endswith": [r"\cmd.exe", r"\powershell.exe", r"\powershell_ise.exe", r"\pwsh.exe"],
      "ParentImage|endswith": r"\dllhost.exe", "IntegrityLevel|equals": "High"}),
    ("SYS-205", 10, "high", "all", ("T1055.012",), "Process opened with suspend/resume-only access rights",
     {"GrantedAccess|equals": "0x800"}),
    ("SYS-206", 10, "high", "all", ("T1055",), "Process access call stack has no ntdll.dll frame",
     {"CallTrace|contains|not": "ntdll.dll"}),
    ("SYS-207", 1, "high", "all", ("T1562.002",), "Crash handler launched for a security-critical Windows service",
     {"Image|endswith": r"\WerFault.exe", "ParentCommandLine|re": r"-s\s+(eventlog|ntds|spooler|netlogon)\b"}),
    ("SYS-208", 17, "high", "all", ("T1569.002",),
     "Named pipe follows PsExec's stdin/stdout/stderr relay naming convention",
     {"PipeName|re": r"-(stdin|stdout|stderr)$"}),
    ("SYS-209", 1, "medium", "all", ("T1564.001",), "attrib.exe used to hide a file",
     {"image|endswith": r"\attrib.exe", "command_line|re": r"(^|\s)\+h(\s|$)"}),
    ("SYS-210", 13, "high", "all", ("T1562.001",),
     "PowerShell execution policy forced to Unrestricted or Bypass via registry",
     {"EventType|equals": "SetValue", "TargetObject|endswith": r"\Microsoft.PowerShell\ExecutionPolicy",
      "Details": ["Unrestricted", "Bypass"]}),
    ("SYS-211", 13, "high", "all", ("T1059.005",), "Office VBA object model access (AccessVBOM) enabled via registry",
     {"EventType|equals": "SetValue", "TargetObject|endswith": r"\Security\AccessVBOM",
      "Details|equals": "DWORD (0x00000001)"}),
    ("SYS-212", 7, "high", "all", ("T1036.005",),
     "Loaded image's PE metadata claims a trusted binary, but it runs from a staging path",
     {"OriginalFileName": TRUSTED_NAMES,
      "image|re": [r"\\users\\[^\\]+\\appdata\\local\\temp\\", r"\\users\\[^\\]+\\downloads\\",
                   r"\\users\\[^\\]+\\desktop\\", r"\\users\\public\\", r"\\windows\\temp\\[^\\]+\.exe",
                   r"\\programdata\\[^\\]+\.exe"]}),
    ("SYS-213", 1, "high", "any", ("T1021.001",),
     "Process executed from a redirected RDP client drive, or SharpRDP tooling ran",
     {"image|startswith": "\\\\tsclient\\", "image|endswith": r"\SharpRDP.exe"}),
    ("SYS-214", 1, "critical", "all", ("T1047", "T1021.002"),
     "WMI-spawned command redirects its output to a hidden administrative share",
     {"parent_image|endswith": r"\WmiPrvSE.exe", "command_line|re": r"\\\\[^\\]+\\(admin|[a-z])\$\\"}),
    ("SYS-215", 7, "critical", "all", ("T1003.001", "T1021.002"), "lsass.exe loaded an image from a network path",
     {"image|endswith": r"\lsass.exe", "ImageLoaded|startswith": "\\\\"}),
    ("SYS-216", 13, "critical", "all", ("T1003.003", "T1021.002"),
     "NTDS DirectoryServiceExtPt registry value points at a network path",
     {"EventType|equals": "SetValue", "TargetObject|endswith": r"\NTDS\DirectoryServiceExtPt",
      "Details|startswith": "\\\\"}),
    ("SYS-217", 13, "high", "all", ("T1021.002",), "New SMB share added directly through the registry",
     {"EventType|equals": "SetValue", "TargetObject|re": r"\\lanmanserver\\shares\\[^\\]+$"}),
    ("SYS-218", 13, "high", "all", ("T1021.002", "T1562.001"), "NullSessionPipes registry value modified",
     {"EventType|equals": "SetValue", "TargetObject|endswith": r"\LanmanServer\Parameters\NullSessionPipes"}),
    ("SYS-219", 17, "high", "all", ("T1071",),
     "Named pipe named as a bare hex string, consistent with a framework-generated backdoor",
     {"PipeName|re": HEX_PIPE}),
    ("SYS-220", 18, "high", "all", ("T1071",), "Connection to a named pipe named as a bare hex string",
     {"PipeName|re": HEX_PIPE}),
]
